"""License scans: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard parser for expressions.

One automaton finds phrases and tags among a text's words. Behind a tag (`SPDX-License-Identifier`, or `license` and
the like with a colon or an equals sign) the longest valid expression is parsed: its identifiers are labels, and the
expression itself, in a normal form that keeps `and` and `or` apart, is a result too. Operands are known identifiers,
a known family with a version, or a `LicenseRef-` of the text's own; words of prose are none.
Defined cases: a null or empty text has no words, no places and score 0; a tag without a valid expression adds no
label; brackets that are left open close at the end of the expression; what follows an expression is passed over; very long texts are read whole, in one pass; several phrases at one
place all count; repeated rows are scanned alike; an empty table gives an empty result; only the id and text columns
are read, whatever else the table has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases of the base, and those that the method adds, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("gnu general public license version 2", "gpl-2"), ("gnu general public license version 3", "gpl-3"), ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"), ("mozilla public license", "mpl"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"),
    ("cc by sa", "cc-by-sa"), ("cc by nd", "cc-by-nd"), ("cc0 1 0", "cc0"), ("creative commons attribution", "cc-by"), ("all rights reserved", "all-rights-reserved"),
    ("gnu free documentation license", "gfdl"), ("artistic license", "artistic"), ("european union public licence", "eupl"), ("common development and distribution license", "cddl"), ("sil open font license", "ofl"), ("do what the fuck you want to public license", "wtfpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"), ("creative commons zero", "cc0"), ("released under the bsd license", "bsd"), ("licensed under the apache license", "apache"), ("all rights are reserved", "all-rights-reserved"),
    ("permission is hereby granted free of charge", "mit"), ("redistribution and use in source and binary forms", "bsd"), ("isc license", "isc"), ("eclipse public license", "epl"), ("boost software license", "bsl-1"),
)
#: Tags, and whether a colon or an equals sign has to follow.
TAGS = (("spdx license identifier", False), ("license", True), ("licence", True), ("licenses", True), ("license expression", True), ("license id", True), ("license identifier", True), ("spdx license", True), ("spdx id", True), ("spdx", True))
#: How sure one place of each sort makes a licence.
SURE = {"base": 0.9, "notice": 0.8, "tag": 0.95}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BETWEEN, MARKED = re.compile(r"[\s:=\"'`\[]*"), re.compile(r"[\"'`]?[ \t]*[:=][ \t]*[\"'`\[]?[ \t]*")
TOKEN = re.compile(r"\s*([()]|[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?)(\.?)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# Licence identifiers of the public SPDX list, lower-cased, without those that a family and a version make.
IDENTIFIERS = frozenset(
    "0bsd aal abstyles adsl afmparse aladdin antlr-pd apafml app-s2p artistic artistic-dist baekmuk bahyph barr beerware bitstream-charter bitstream-vera blessing borceux bsd-source-code bsd-attribution-hpnd-disclaimer "
    "caldera catharon cc-pddc cecill-b cecill-c clartistic cnri-jython cnri-python cnri-python-gpl-compatible cornell-lossless-jpeg crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm efl egenix elastic entessa "
    "epics erlpl-1.1 etalab fair fsful fsfullr fsfullrwd ftl fwlw giftware gl2ps glide glulxe glwtpl gnuplot gtkbook hdparm hpnd hpnd-sell-variant ibm-pibs icu ijg imagemagick imlib2 info-zip intel intel-acpi isc jam jasper-2.0 json "
    "jpnic knuth-ctan latex2e leptonica libpng libselinux-1.0 libtiff linux-openib lucida-bitmap-fonts magaz makeindex metamail miros mit mit-0 mit-advertising mit-cmu mit-enna mit-feh mit-festival mit-modern-variant mit-open-group mit-wu mitnfa "
    "motosoto mpich2 ms-pl ms-rl mtll multics mup naist-2003 nbpl-1.0 ncsa net-snmp netcdf newsletr ngpl nis-nlod nist-pd nist-software nokia noweb npl nrl ntp ntp-0 o-uda-1.0 ogc-1.0 oml openssl openssl-standalone padl plexus pnmstitch "
    "postgresql psfrag psutils python qhull qtpl radvd-2.0 rsa-md rscpl ruby sax-pd saxpath scea sendmail sgi-opengl sissl smlnj snia spencer-86 ssh-openssh ssh-short sunpro swl tcl tcp-wrappers tmate torque-1.1 tosl tu-berlin-1.0 "
    "ulem unicode-dfs-2015 unicode-dfs-2016 unicode-tou unlicense vim vostrom w3c wsuipa wtfpl x11 xerox xfig xnet xpp zed zlib zlib-acknowledgement".split()
)
# Families of the public list whose identifiers are the family, a version and what may follow it.
FAMILIES = "afl|agpl|apache|apsl|artistic|bittorrent|blueoak|bsd|bsl|busl|cal|catosl|cc-by|cc-by-nc|cc-by-nc-nd|cc-by-nc-sa|cc-by-nd|cc-by-sa|cc0|cddl|cdla-permissive|cdla-sharing|cecill|cern-ohl|cern-ohl-p|cern-ohl-s|cern-ohl-w|cpal|cpl|cuda|d-fsl|ecl|efl|epl|eudatagram|eupl|frameworx|gfdl|gpl|hippocratic|interbase|ipl|lal|lgpl|lgpllr|liliq-p|lpl|lppl|mpl|mulanpsl|nasa|ncgl-uk|nlod|nosl|npl|nposl|odbl|odc-by|ofl|ogl-uk|oldap|osl|parity|pddl|php|polyform-noncommercial|polyform-small-business|psf|python|qpl|rpl|rpsl|sgi-b|shl|spl|sspl|tapr-ohl|tpl|ucl|upl|vsl|w3c|wxwindows|ypl|zend|zimbra|zpl"
VERSIONED = re.compile(rf"(?:{FAMILIES})-[0-9]+(?:\.[0-9]+)*(?:-[a-z0-9]+)*\+?")
OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|llgpl|font-exception|openssl|u-boot")


def identifier(token: str) -> bool:
    return token.removesuffix("+") in IDENTIFIERS or bool(VERSIONED.fullmatch(token) or OWN.fullmatch(token))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sort, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase, label in phrases:
            found.add_word(f" {phrase} ", (len(phrase) + 1, sort, label))
    found.make_automaton()
    return found


def label_of(identifier: str) -> str:
    """`apache-2.0` and `gpl-3.0-only` as the labels that phrases give: `apache-2`, `gpl-3`."""
    bare = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    return re.sub(r"^(apache|gpl|lgpl|agpl|mpl|epl|bsl)-(\d+)\.\d+$", r"\1-\2", bare)


def valid_prefix(text: str, at: int) -> list[str]:
    """The tokens of the longest valid expression that begins at a place of a text; open brackets are closed behind its last operand."""
    tokens: list[str] = []
    valid, open_, depth, operand, excepting, excepted = 0, 0, 0, True, False, False
    while found := TOKEN.match(text, at):
        token, at = found[1], found.end()
        if token in PRECEDENCE:
            if operand or token == "with" and (excepted or tokens[-1] == ")"):
                break
            operand, excepting, excepted = True, token == "with", False
        elif token == "(":
            if not operand or excepting:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif operand and (EXCEPTION.fullmatch(token) if excepting else identifier(token)):
            operand, excepted = False, excepting
        else:
            break
        tokens.append(token)
        if not operand:
            valid, open_ = len(tokens), depth
        if found[2]:  # the end of a sentence
            break
    return tokens[:valid] + [")"] * open_


def evaluate(tokens: list[str]) -> tuple[set[str], str]:
    """The labels of a valid expression and its normal form: a shunting yard on two stacks.

    Operands of `or` are alternatives and those of `and` all apply: both are put in order, and an `or` within an `and`
    keeps its brackets. An exception after `with` stays with its licence and is no label.
    """
    output: list[tuple[str, set[str], set[str]]] = []  # operator, operands in normal form, labels
    waiting: list[str] = []

    def text(op: str, operands: set[str]) -> str:
        return f" {op} ".join(sorted(operands))

    def apply() -> None:
        op, right, left = waiting.pop(), output.pop(), output.pop()
        if op == "with":
            output.append(("", {f"{text(*left[:2])} with {text(*right[:2])}"}, left[2]))
            return
        sides = [x[1] if x[0] in ("", op) else {f"({text(*x[:2])})" if op == "and" else text(*x[:2])} for x in (left, right)]
        output.append((op, sides[0] | sides[1], left[2] | right[2]))

    for token in tokens:
        if token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                apply()
            waiting.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        else:
            output.append(("", {label_of(token)}, {label_of(token)}))
    while waiting:
        apply()
    op, operands, labels = output[0]
    return labels, text(op, operands)


def scan(text: str | None, places: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first word, comma-joined), expressions (semicolons between)."""
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    line = f" {' '.join(words)} "
    base, labels, starts, doubt, spans, tags, seen, at = set(), set(), [], 1.0, [], [], 0, 0
    for end, (length, sort, label) in places.iter(line):
        start = end - length
        at, seen = at + line.count(" ", seen, start) if start >= seen else at - line.count(" ", start, seen), start
        if sort == "tag":
            tags.append((at, line.count(" ", start + 1, end) + 1, label))
            continue
        if sort == "base":
            base.add(label)
            starts.append(at)
        labels.add(label)
        doubt *= 1 - SURE[sort]
        spans.append(f"{label}:{at}")
    expressions = []
    if tags:  # from the number of a tag's last word to its place in the text
        ends = [m.end() for m in WORD.finditer(low)]
        read = 0  # a longer tag may hold a shorter one; an expression is read once
        for tag, n_words, marked in sorted(tags, key=lambda x: (x[0] + x[1], x[0])):
            end = ends[tag + n_words - 1]
            gap = MARKED.match(low, end) if marked else BETWEEN.match(low, end)
            tokens = valid_prefix(low, gap.end()) if gap and end > read else []
            if tokens:
                more, form = evaluate(tokens)
                labels |= more
                doubt *= 1 - SURE["tag"]
                spans.append(f"tag:{tag}")
                expressions.append(form)
                read = end
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(1 - doubt, 9), ",".join(spans), ";".join(expressions)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document; one scan, no shuffle."""
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans", "expressions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = automaton()
        for batch in batches:
            found = pd.DataFrame([scan(t, places) for t in batch["text"]], columns=columns, index=batch.index)
            yield pd.concat([batch[["doc_id"]], found.astype({"first_word": "Int64", "last_word": "Int64"})], axis=1)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string, expressions string")
