"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\u000b\\f\\r]"

# What counts as a legal form, a guessed suffix, an abbreviation, a board vendor and its name's shape.
LEGAL_FORMS = "gmbh|ag|se|inc|ltd|llc|limited|group|co|kgaa|plc|sa|sas|bv"
NAME_SUFFIXES = "gmbh|ag|se|inc|ltd|llc|group|technologies|technology|labs|io|hq"
ABBREVIATIONS = (("sr", "senior"), ("jr", "junior"), ("mgr", "manager"))
GENDER_NOTE = "(?i)\\(\\s*(?:all genders|[mwfdxhi]\\s*(?:[/|,*]\\s*[mwfdxhi]\\s*)+)\\)"
VENDORS = ("greenhouse", "lever", "lever_eu", "ashby", "workable", "smartrecruiters", "recruitee", "teamtailor", "personio", "bamboohr")
BOARD_NAME = "[A-Za-z0-9][A-Za-z0-9._-]{0,99}"
BOARD_NAMES = {"teamtailor": "[a-z0-9-]+\\.teamtailor\\.com", "personio": "[a-z0-9-]+\\.jobs\\.personio\\.(?:de|com)", "bamboohr": "[a-z0-9-]+\\.bamboohr\\.com"}
BOARD_URLS = (
    ("greenhouse", "(?:boards|job-boards)(?:\\.eu)?\\.greenhouse\\.io/(?:embed/job_board\\?for=)?([A-Za-z0-9_-]+)"),
    ("greenhouse", "boards-api\\.greenhouse\\.io/v1/boards/([A-Za-z0-9_-]+)"),
    ("lever_eu", "jobs\\.eu\\.lever\\.co/([A-Za-z0-9._-]+)"),
    ("lever", "jobs\\.lever\\.co/([A-Za-z0-9._-]+)"),
    ("lever", "api\\.lever\\.co/v0/postings/([A-Za-z0-9._-]+)"),
    ("ashby", "jobs\\.ashbyhq\\.com/([A-Za-z0-9._%-]+)"),
    ("ashby", "api\\.ashbyhq\\.com/posting-api/job-board/([A-Za-z0-9._-]+)"),
    ("workable", "apply\\.workable\\.com/([A-Za-z0-9_-]+)"),
    ("smartrecruiters", "(?:careers|jobs)\\.smartrecruiters\\.com/([A-Za-z0-9_-]+)"),
    ("recruitee", "([a-z0-9-]+)\\.recruitee\\.com"),
    ("teamtailor", "([a-z0-9-]+\\.teamtailor\\.com)"),
    ("personio", "([a-z0-9-]+\\.jobs\\.personio\\.(?:de|com))"),
    ("bamboohr", "([a-z0-9-]+\\.bamboohr\\.com)"),
)
NO_BOARDS = ("embed", "jobs", "v1", "api", "careers", "www", "app", "apply", "widget", "job_board")
# The names by which a language is asked for.
LANGUAGES = {
    "en": ["English"], "fr": ["French"], "de": ["German"], "nl": ["Dutch", "Flemish"], "it": ["Italian"], "es": ["Spanish", "Castilian"],
    "pt": ["Portuguese"], "pl": ["Polish"], "cs": ["Czech"], "sk": ["Slovak"], "hr": ["Croatian"], "sr": ["Serbian"], "sl": ["Slovenian", "Slovene"],
    "sv": ["Swedish"], "da": ["Danish"], "no": ["Norwegian"], "fi": ["Finnish"], "el": ["Greek"], "ro": ["Romanian"], "hu": ["Hungarian"],
    "bg": ["Bulgarian"], "lt": ["Lithuanian"], "lv": ["Latvian"], "et": ["Estonian"], "tr": ["Turkish"], "uk": ["Ukrainian"], "ru": ["Russian"],
    "ca": ["Catalan"], "he": ["Hebrew"], "ar": ["Arabic"], "ja": ["Japanese"], "ko": ["Korean"], "zh": ["Chinese", "Mandarin", "Cantonese"], "hi": ["Hindi"],
}

# What makes a language a requirement, what softens it, and which nouns make a name no language.
CUES = (
    r"fluen(?:t|cy)|proficien(?:t|cy)|(?<!AI[- ])(?<!cloud[- ])(?<!digital[- ])\bnative\b|bilingual|mother tongue|\bC[12]\b"
    r"|(?:business|professional|working)[- ]level|written and (?:spoken|verbal)|(?:spoken|verbal) and written|\bspeakers?\b|\bspeak\b|required|requirement"
    r"|\bmust\b|mandatory|essential|non\\?-negotiable|command of|(?:knowledge of|skills in) (?-i:[A-Z])"
)
SOFTENERS = (
    r"\bplus\b|bonus|nice[- ]to[- ]have|advantage|preferred|preferably|desirable|desired|\basset\b|beneficial|ideally|appreciated|welcome|\bhelps?\b|helpful|optional"
    r"|n[o\u2019']t (?:be )?(?:required|necessary|needed|mandatory|essential|expected|a must|something)"
)
NOUNS = r"markets?|sector|industry|customers?|clients?|users?|region|law|regulations?|legislation|compan(?:y|ies)|teams?|office|government|authorit(?:y|ies)|entity|subsidiary"
#: How many characters a cue may be away from a language's name.
NEAR = 40
# Letters that fold to several.
FOLDED = (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
# Markdown escapes, noise in front of and behind a sentence, bullets, numbers, and where a sentence ends.
ESCAPED, LEAD, TRAIL = r"\\([-_*.\[\]()#+!`&|~<>])", "^[\\s*_>#•·‣◦-]+", "[\\s*_#]+$"
PREFIX, NUMBER, STOP = "^[•·*‣◦\\-]\\s*", "^\\d+[.)]\\s+", "(?<=[.!?])\\s+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without any white space at either end (trim() knows blanks only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_sentence(c: Column | str) -> Column:
    """Markdown escapes undone; bold marks, leading bullets and headings, trailing emphasis gone."""
    t = F.regexp_replace(text(c), ESCAPED, "$1")
    t = F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(t, LEAD, ""), TRAIL, ""))


def sentences(c: Column | str) -> Column:
    """An array of a text's sentences of at least five characters.

    A line that starts with , ; : or ) goes on with the one above: the break before it, and the noise around the break,
    go in one replacement (both patterns move forward only). Lines are then cut at stops, and what is left is cleaned.
    """
    lines = F.regexp_replace(text(c), "\n\\s*+", "\n")
    lines = F.regexp_replace(lines, "(?<![\\s*_#])[\\s*_#]*+(?<=\n)(?=[,;:)])", "")
    parts = F.flatten(F.transform(F.split(lines, "\n"), lambda x: F.split(clean_sentence(x), STOP)))
    bare = F.transform(parts, lambda x: clean_sentence(F.regexp_replace(F.regexp_replace(strip(x), PREFIX, ""), NUMBER, "")))
    return F.filter(bare, lambda x: F.length(x) >= 5)


def requirement(title: Column | str, body: Column | str, readable: list[str]) -> Column:
    """The first sentence that asks for a language outside the readable ones (codes or names), or ''; a title that asks for speakers is one.

    A cue and a name close to each other are one pattern in either order; texts that name no other language are not
    parted at all.
    """
    code_of = {n.lower(): c for c, names in LANGUAGES.items() for n in (c, *names)}
    known = {code_of[k] for r in readable for k in (r.strip().lower(), r.strip().lower().split("-")[0]) if k in code_of}
    if not known:
        return F.lit("")
    own = "|".join(n for c in sorted(known) for n in LANGUAGES[c])
    other = "|".join(n for c, names in LANGUAGES.items() if c not in known for n in names)
    asked = f"\\b(?:{other})\\b(?!(?: [\\w-]+){{0,2}} (?:{NOUNS})\\b)"
    between = f".{{0,{NEAR - 1}}}"
    near = f"(?sU){asked}{between}(?i:{CUES})|(?i:{CUES}){between}{asked}|(?i:knowledge of|skills in) {asked}"
    excused = f"(?U)(?i:{SOFTENERS})|\\b(?:{own})\\b,? (?:and/)?or\\b|\\bor (?:{own})\\b|\\beither\\b"
    both = F.concat(text(title), F.lit("\n"), text(body))
    found = F.filter(F.split(both, "[.;\n]+"), lambda x: x.rlike(near) & ~x.rlike(excused))
    said = F.when(text(title).rlike(f"(?U)\\b(?:{other})\\\\?[- ][Ss]peak(?:ing|er)\\b"), strip(text(title))).otherwise(F.coalesce(strip(F.get(found, F.lit(0))), F.lit("")))
    return F.when(both.rlike(f"(?U)\\b(?:{other})\\b"), said).otherwise(F.lit(""))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def normal_text(c: Column | str) -> Column:
    """Tags and what is no word to blanks, lower case, single blanks."""
    t = F.regexp_replace(text(c), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}]+", " "))


def normal_title(c: Column | str) -> Column:
    t = normal_text(c)
    for short, full in ABBREVIATIONS:
        t = F.regexp_replace(t, f"\\b{short}\\b", full)
    return t


def quote_form(c: Column | str) -> Column:
    """Markdown gone, quote marks, dashes and blanks folded, case folded: how quotes are compared."""
    t = F.regexp_replace(text(c), r"\\([\\`*_{}\[\]()#+\-.!&|~<>])", "$1")
    t = F.regexp_replace(t, "[*_`#>|~]+", " ")
    t = F.translate(t, "’‘“”«»‐‑–—\u00a0\u202f", "''\"\"\"\"----  ")
    t = F.translate(F.lower(strip(F.regexp_replace(t, "\\s+", " "))), "ſς", "sσ")
    for one, folded in FOLDED:
        t = F.replace(t, F.lit(one), F.lit(folded))
    return t


def quote_in_text(quote: Column | str, body: Column | str) -> Column:
    """Whether every piece of the quote (pieces are parted by ... or …) is in the text, one behind the other."""
    return quote_in_form(quote, quote_form(body))


def quote_in_form(quote: Column | str, hay: Column) -> Column:
    """quote_in_text() for a text whose quote_form() is there already, for several quotes of one text."""
    pieces = F.filter(F.transform(F.split(text(quote), "\\.{3}|…"), quote_form), lambda p: p != "")

    def step(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, hay, F.greatest(at, F.lit(1)))
        return F.when((at > 0) & (found > 0), (found + F.length(piece)).cast("int")).otherwise(F.lit(0))

    return (F.size(pieces) > 0) & (F.aggregate(pieces, F.lit(1), step) > 0)


def plain(c: Column | str, unescape) -> Column:
    """HTML as text with line breaks; `unescape` is the entity helper, applied twice as boards escape twice."""
    t = F.regexp_replace(unescape(unescape(text(c))), "<[^>]+>", "\n")
    return strip(F.regexp_replace(t, "\\s+\n", "\n"))


def norm(c: Column | str) -> Column:
    """A title as boards are compared: no gender note, lower case, ASCII letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text(c), GENDER_NOTE, " ")), "[^a-z0-9]+", " "))


def company_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(norm(c), f"\\b({LEGAL_FORMS})\\b", ""), "\\s+", " "))


def slugs(c: Column | str) -> Column:
    """Board names a company may use, best guess first."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    bare = F.regexp_replace(base, f"-({NAME_SUFFIXES})$", "")
    dashless = lambda x: F.replace(x, F.lit("-"), F.lit(""))
    return F.filter(F.array_distinct(F.array(base, dashless(base), bare, dashless(bare))), lambda s: s != "")


def valid_board(vendor: Column, slug: Column) -> Column:
    ok = F.when(vendor.isin(*[v for v in VENDORS if v not in BOARD_NAMES]), text(slug).rlike(f"^(?:{BOARD_NAME})\\z"))
    for name, shape in BOARD_NAMES.items():
        ok = ok.when(vendor == name, text(slug).rlike(f"^(?:{shape})\\z"))
    return F.coalesce(ok, F.lit(False))


def board_from_url(url: Column | str) -> Column:
    """A struct of vendor and slug: the first pattern that matches with a valid name that is not reserved, or null."""
    tries = []
    for vendor, pattern in BOARD_URLS:
        slug = F.regexp_extract(text(url), pattern, 1)
        ok = (slug != "") & ~F.lower(slug).isin(*NO_BOARDS) & valid_board(F.lit(vendor), slug)
        tries.append(F.when(ok, F.struct(F.lit(vendor).alias("vendor"), slug.alias("slug"))))
    return F.coalesce(*tries)


def url_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(strip(text(c))), 256), 1, 16)


def block_signature(blocks: Column) -> Column:
    line = lambda b: F.concat_ws("|", b["index"].cast("string"), b["matched"].cast("int").cast("string"), b["sentence"])
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) <= 0, "").otherwise(F.md5(F.array_join(F.transform(blocks, line), "\n")))


def rubric_version(c: Column | str) -> Column:
    return F.substring(F.md5(text(c)), 1, 12)


def language_codes(names: Column) -> Column:
    """ISO codes of an array of names and codes; what is neither is left out."""
    known = F.create_map(*[x for code, words in LANGUAGES.items() for key in (code, *map(str.lower, words)) for x in (F.lit(key), F.lit(code))])
    bare = lambda n: F.lower(strip(text(n)))
    code = lambda n: F.coalesce(F.try_element_at(known, F.split_part(bare(n), F.lit("-"), F.lit(1))), F.try_element_at(known, bare(n)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, code), lambda c: c.isNotNull())))


def run_stamp(c: Column | str) -> Column:
    return F.regexp_replace(text(c), "[^0-9A-Za-z._-]", "-")


def source_of(vendor: Column, slug: Column) -> Column:
    return F.concat(F.lit("ats:"), vendor, F.lit("/"), slug)


def board_of_source(c: Column | str) -> Column:
    col = text(c)
    return F.struct(F.regexp_extract(col, "^ats:([^/]+)/(.+)$", 1).alias("vendor"), F.regexp_extract(col, "^ats:([^/]+)/(.+)$", 2).alias("slug"))


def older_than(moment: Column, now, days: int) -> Column:
    return moment.cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def literal_keyword(body: Column | str, keyword: str) -> Column:
    """A keyword with a symbol in it: as written, in any case, not inside a word."""
    import re

    return text(body).rlike(f"(?i)(?<!\\w){re.escape(keyword.strip())}(?!\\w)")


def excluded(title: Column | str, description: Column | str, words: list[str]) -> Column:
    """Whether any of the words is in the title or description, as a plain part in any case."""
    hay = F.concat(F.lower(text(title)), F.lit("\n"), F.lower(text(description)))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(hay, F.lit(w.lower()))
    return out
