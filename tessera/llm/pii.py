"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a classifier decides.

Exact patterns (the base) are always kept. More spans are proposed by wider patterns, by a gazetteer (spelled-out
addresses that end in a known domain, numbers that begin with a known dialling code) and by context (numbers behind a
word that announces them, whatever parts their digits). Regex, gazetteer and context labelers vote on every span,
whoever proposed it, so that they disagree; expectation-maximisation over the counts of vote patterns estimates each labeler's reliability,
and a logistic regression trained on the estimates decides on what is no base span. Defined cases: a null or empty
text has no spans; places are code points, ends exclusive; spans of one kind do not overlap (base first, then the
leftmost), kinds may; texts without an @ or digit are passed over quickly; very long texts are read whole; repeated
rows are alike; an empty table gives an empty result; only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import smallest
from tessera.operators.graph import cut

KINDS = ("email", "ip", "card", "phone")
#: Spans that the classifier is fitted on (smallest seeded hashes first).
SAMPLE, SLOTS = 20_000, 24
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns: written-out addresses, spaced or bracketed numbers, eight-part addresses.
WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[.\x20-]){3}[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")),
)
CUES = {
    "email": re.compile(r"(?i)e-?mail|mail|contact|write|correo|courriel|schreib"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login|from"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|call|tel|fax|mobile|cell|ruf|appel|llama"),
}
#: Domain endings, card issuers' first digits and dialling codes that the gazetteer knows.
ENDINGS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info", "biz", "co"}
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62", "2221", "2720")
CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "351", "353", "358", "380", "420")
LABELERS = ("pattern", "check", "gazetteer", "cue", "shape")
#: Words between the parts of a spelled-out address; a text without an @, [at] or one of these has none.
BETWEEN = (" dot ", " punto ", " punkt ", " point ")
WRAPPED = ("[at]", "(at)", "{at}")
#: Addresses in words or pieces, whose last word the gazetteer has to know.
SPELLED = re.compile(r"(?i)(?<![\w.%+@-])[a-z0-9._%+-]{1,64}(?:\s(?:at|arroba)\s[a-z0-9-]{1,63}(?:\s(?:dot|punto|punkt|point)\s[a-z0-9-]{1,63}){1,4}|(?:\s@\s?|@\s)[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,4})(?![\w-])")
#: International numbers without a plus, the dialling code set off.
DIALLED = re.compile(r"(?<![0-9.+-])(?:00|\(00\)|011[\x20-])[\x20.-]?[1-9][0-9]{0,2}[\x20()./-]{1,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,11}(?![0-9])")
#: Digits near each other, which context may make a number of.
DIGITS = re.compile(r"\+?\(?[0-9](?:[\x20()./,_\[\]-]{0,3}[0-9]){3,}")
#: Words that announce a number, in front of it, and what the number may look like.
BEHIND = (
    ("ip", re.compile(r"(?i)\b(?:ip|ip[\x20-]?address|ip-adresse|host|server|login from)\b[^0-9\n]{0,12}\Z"), re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|[\x20,_-]|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9.])")),
    ("card", re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta)\b[^0-9\n]{0,16}\Z"), re.compile(r"[0-9](?:[\x20./_-]{0,2}[0-9]){13,18}(?![0-9])")),
    ("phone", re.compile(r"(?i)\b(?:phone|telephone|tel|call|call me|fax|mobile|cell|whatsapp|telefon|anruf|teléfono|téléphone|móvil|handy)\b[^0-9+\n]{0,12}\Z"), re.compile(r"\+?\(?[0-9](?:[\x20()./_-]{0,3}[0-9]){6,14}(?![0-9])")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, failing matches dropped without a retry."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def votes(kind: int, span: str, before: str, base: bool) -> list[int]:
    """1 for personal data, 0 against, 2 no vote; in the order of LABELERS."""
    digits = re.sub("[^0-9]", "", span)
    cue = 1 if CUES[KINDS[kind]].search(before) else 2
    if kind == 0:
        host = re.split(r"\W+", span.lower())
        return [int(base), 1 if "." in span or re.search(r"(?i)\b(dot|punto|punkt|point)\b", span) else 0, 1 if host[-1] in ENDINGS else 2, cue, int(6 <= len(span) <= 80)]
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        four = len(parts) == 4 and all(int(p) <= 255 for p in parts) and ":" not in span
        return [int(base), 1 if four or span.count(":") == 7 else 0, 0 if parts[0] in ("0", "127", "255") else 2, cue, int(not span.startswith("0") and not re.search(r"[0-9][\x20,_-][0-9]", span))]
    if kind == 2:
        return [int(base), int(luhn(digits)), 1 if digits.startswith(ISSUERS) else 0, cue, int(14 <= len(digits) <= 19)]
    abroad = digits[2:] if digits.startswith("00") else digits[3:] if digits.startswith("011") else digits
    return [int(base), int(9 <= len(abroad) <= 15), 1 if abroad.startswith(CODES) and (abroad != digits or "+" in span) else 2, cue, int(len(set(digits)) > 3)]


def proposals(text: str, mails: bool) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what wider patterns, gazetteer and context find; spans of one kind may overlap."""
    for name, pattern in WIDE:
        if mails or name != "email":
            for m in pattern.finditer(text):
                yield KINDS.index(name), *m.span()
    if mails and (" @" in text or "@ " in text or any(w in text.lower() for w in BETWEEN)):
        for m in SPELLED.finditer(text):
            if re.split(r"\W+", m[0].lower())[-1] in ENDINGS:
                yield 0, *m.span()
    for run in DIGITS.finditer(text):
        before = text[max(0, run.start() - 40) : run.start()]
        for name, cue, number in BEHIND:
            if (m := number.match(text, run.start())) and cue.search(before):
                yield KINDS.index(name), *m.span()
        if (m := DIALLED.match(text, run.start())) and re.sub("[^0-9]", "", m[0]).removeprefix("00").removeprefix("011").startswith(CODES):
            yield 3, *m.span()


def features(kind: int, span: str, before: str, vote: list[int]) -> list[float]:
    x = [0.0] * SLOTS
    x[kind] = 1.0
    x[4] = min(len(span), 64) / 64
    x[5] = sum(map(str.isdigit, span)) / max(1, len(span))
    for i, v in enumerate(vote[1:]):  # what the pattern says is left out: the classifier has to do without
        x[6 + 2 * i + (v == 1)] = float(v != 2)
    words = before.lower().split()
    if words:
        x[14 + zlib.crc32(words[-1].encode()) % (SLOTS - 14)] = 0.5
    return x


def candidates(text: str | None) -> list[dict]:
    """Every base span, and what the wider patterns add without overlapping one of its kind."""
    text = text or ""
    mails = "@" in text or any(w in text for w in WRAPPED) or any(w in text.lower() for w in BETWEEN)
    if not mails and not re.search("[0-9]", text):
        return []
    base = base_spans(text)
    found = [(*s, True) for s in base]
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in range(len(KINDS))}
    # base first, then the leftmost and of those the longest; spans of one kind do not overlap
    for kind, a, b in sorted(set(proposals(text, mails)), key=lambda x: (x[1], -x[2], x[0])):
        own = taken[kind]
        i = bisect_left(own, (b, 0))
        if not i or own[i - 1][1] <= a:
            own.insert(i, (a, b))
            found.append((kind, a, b, False))
    out = []
    for kind, a, b, is_base in sorted(found, key=lambda x: (x[1], x[0])):
        before = text[max(0, a - 40) : a]
        vote = votes(kind, text[a:b], before, is_base)
        out.append({"kind": kind, "start": a, "end": b, "base": is_base, "votes": "".join(map(str, vote)), "x": features(kind, text[a:b], before, vote)})
    return out


def expectation_maximisation(patterns: pd.DataFrame, rounds: int = 50) -> dict[tuple[int, str], float]:
    """P(personal) of each (kind, votes) from their counts alone: labelers are independent given the truth."""
    out: dict[tuple[int, str], float] = {}
    for kind, rows in patterns.groupby("kind"):
        v = np.array([[int(c) for c in p] for p in rows["votes"]])
        n = rows["n"].to_numpy(float)
        right = np.full((2, v.shape[1]), 0.8)  # right[y, j]: labeler j votes y when y is true
        prior = 0.5
        for _ in range(rounds):
            like = [np.log(prior if y else 1 - prior) + (np.where(v == y, np.log(right[y]), np.where(v == 1 - y, np.log(1 - right[y]), 0))).sum(1) for y in (0, 1)]
            p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
            prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.02, 0.98))
            for y, q in ((0, 1 - p), (1, p)):
                voted = (n * q)[:, None] * (v != 2)
                right[y] = np.clip(((voted * (v == y)).sum(0) + 4) / (voted.sum(0) + 5), 0.05, 0.98)
        out |= {(int(kind), s): float(x) for s, x in zip(rows["votes"], p, strict=True)}
    return out


def fit(x: np.ndarray, p: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (q - p) + ridge * w)
    return w


SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,x:array<float>>>"


def found_spans(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and every candidate span with its votes and features: the one scan of the texts."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(_spans=[candidates(t) for t in batch["_text"]])

    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"_spans {SPAN}"]))


def trained(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    spans = found.select(F.explode("_spans").alias("s")).select("s.*")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).toPandas()  # 4 x 3 ** 5 rows at most
    truth = expectation_maximisation(patterns.sort_values(["kind", "votes"]))
    rows = smallest(spans, F.xxhash64(F.lit(11), "start", "end", "votes", "x"), sample, "kind", "start", "votes", rows=int(patterns["n"].sum())).select("kind", "votes", "x").collect()
    if not rows:
        return np.zeros(SLOTS + 1)
    return fit(np.array([r["x"] for r in rows], float), np.array([truth[r["kind"], r["votes"]] for r in rows]))


def chosen_spans(weights: np.ndarray, threshold: float = 0.5):
    """A column of the spans that stay: the base, and of the rest what the classifier takes."""
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    logit = lambda s: F.aggregate(F.zip_with(s["x"], w, lambda a, b: a * b), F.lit(float(weights[-1])), lambda t, y: t + y)
    return F.filter("_spans", lambda s: s["base"] | (1 / (1 + F.exp(-logit(s))) >= threshold))


def personal_data(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all)."""
    found = cut(found_spans(docs, [id_col], text_col))
    weights = trained(found, sample)
    name = F.array(*[F.lit(k) for k in KINDS])
    row = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    base = F.array_join(F.transform(F.filter("_spans", lambda s: s["base"]), row), ",")
    return found.select(F.col(f"`{id_col}`").alias("doc_id"), *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(chosen_spans(weights), row), ",").alias("spans"))


def redacted(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The documents with each chosen span replaced by its kind, as in `<email>`; all columns stay (n_chars follows).

    The classifier is fitted from the spans alone; the second scan finds them again, so that texts are not shuffled.
    """
    spans = cut(found_spans(docs.select(F.col(f"`{text_col}`").alias("text")), [], "text"))
    weights = trained(spans, sample)
    columns, schema = docs.columns, docs.schema

    def mask(text: str | None) -> str | None:
        got = candidates(text)
        if not got:
            return text
        keep = [s for s in got if s["base"] or np.dot(np.array(s["x"], "f4"), weights[:-1]) + weights[-1] >= 0]
        out, at = [], 0
        for s in sorted(keep, key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([mask(t) for t in texts], dtype=object)

    out = docs.withColumn(text_col, masked(F.col(f"`{text_col}`")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType))
    return out.select(*columns)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
