"""Keywords of many profiles, looked up together: a text is parted and stemmed once, whatever the number of keywords.

Keywords become three Aho-Corasick automata: of stems, of exact tokens (acronyms) and of characters (keywords with a
symbol). Equal keywords of different profiles are one entry; its owners are joined on afterwards, so the cost of a text
follows its tokens and its hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectorized import TOKEN, keyword_form, stem

HITS = "lines int, hits array<struct<keyword_n:int,lines:array<int>>>"
#: A text's tokens and its line breaks, which no keyword goes over.
LINE_TOKEN = re.compile(TOKEN.pattern + r"|\n")
MOST_SPELLINGS = 1 << 18


class Automata:
    """keywords: text of each entry, by its number."""

    def __init__(self, keywords: dict[int, str]):
        runs: dict[str, dict[tuple, list[int]]] = {"exact": {}, "stems": {}}
        literal: dict[str, list[int]] = {}
        for n, keyword in keywords.items():
            form = keyword_form(keyword)
            if form and form[0] == "literal":
                literal.setdefault(form[1].lower(), []).append(n)
            elif form:
                runs[form[0]].setdefault(tuple(form[1]), []).append(n)
        self.known = {kind: {t: i for i, t in enumerate(dict.fromkeys(t for run in some for t in run), 1)} for kind, some in runs.items()}
        self.of = {}
        for kind, some in runs.items():
            self.of[kind] = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for run, ns in some.items():
                self.of[kind].add_word(tuple(self.known[kind][t] for t in run), ns)
        self.single = {kind: {self.known[kind][run[0]]: ns for run, ns in some.items() if len(run) == 1} for kind, some in runs.items()}
        self.seen: dict[str, dict[str, int]] = {"exact": {}, "stems": {}}
        self.literal = ahocorasick.Automaton()
        for text, ns in literal.items():
            self.literal.add_word(text, (len(text), ns))
        for automaton in (*self.of.values(), self.literal):
            if len(automaton):
                automaton.make_automaton()

    def hits(self, text: str) -> dict[int, list[int]]:
        """The numbers of the keywords in a text, each with the lines that have it, in order."""
        found: dict[int, dict[int, None]] = {}
        tokens = LINE_TOKEN.findall(text)
        breaks: list[int] | None = None
        for kind, automaton in self.of.items():
            for at, ids in self._known_runs(kind, tokens) if len(automaton) else ():
                # a run of one token is looked up, longer ones go through the automaton
                for end, ns in automaton.iter(ids) if len(ids) > 1 else ((0, self.single[kind].get(ids[0], ())),):
                    if ns and breaks is None:
                        breaks = [i for i, t in enumerate(tokens) if t == "\n"]
                    for n in ns:
                        found.setdefault(n, {})[bisect_left(breaks, at + end)] = None
        if len(self.literal):
            low = text.lower()
            for end, (length, ns) in self.literal.iter(low):
                start = end + 1 - length
                if not (start and _in_word(low[start - 1]) or end + 1 < len(low) and _in_word(low[end + 1])):
                    line = low.count("\n", 0, start)
                    for n in ns:
                        found.setdefault(n, {})[line] = None
        return {n: sorted(found[n]) for n in sorted(found)}

    def _known_runs(self, kind: str, tokens: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Place and numbers of the tokens, one behind the other, that keywords have; each spelling is looked up once."""
        seen, known = self.seen[kind], self.known[kind]
        ids = list(map(seen.get, tokens))
        if None in ids:
            if len(seen) > MOST_SPELLINGS:
                seen.clear()
            for i, n in enumerate(ids):
                if n is None:
                    t = tokens[i]
                    ids[i] = seen[t] = 0 if t == "\n" else known.get(stem(t) if kind == "stems" else t, 0)
        on = [i for i, n in enumerate(ids) if n]
        first = 0
        for k, i in enumerate(on):
            if k + 1 == len(on) or on[k + 1] != i + 1:
                yield on[first], tuple(ids[on[first] : i + 1])
                first = k + 1


def _in_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def numbered_keywords(keywords: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """Rows of keywords (profile_id, place, keyword) with keyword_n, and the distinct texts by that number.

    The table is a configuration: profiles by a few hundred keywords; the driver takes its distinct texts.
    """
    texts = [r.keyword for r in keywords.select("keyword").where("trim(coalesce(keyword, '')) <> ''").distinct().orderBy("keyword").collect()]
    numbers = keywords.sparkSession.createDataFrame([(t, n) for n, t in enumerate(texts)], "_k string, keyword_n int")
    return keywords.join(numbers, F.col("keyword") == F.col("_k")).drop("_k"), dict(enumerate(texts))


def keyword_hits(texts: dict[int, str]) -> Callable:
    """(text) -> the number of its lines, and the keywords found, by number, each with the places of the lines that have it; null stays null."""
    built: list[Automata] = []

    @F.pandas_udf(HITS)
    def run(body: pd.Series) -> pd.DataFrame:
        if not built:  # once in a worker
            built.append(Automata(texts))
        out = []
        for text in body:
            hits = built[0].hits(text) if text else {}
            out.append((text.count("\n") + 1 if text else 0, [{"keyword_n": n, "lines": at} for n, at in hits.items()]))
        return pd.DataFrame(out, columns=["lines", "hits"])

    return run
