"""Benchmark decontamination with a generalised suffix automaton over the words of test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, stored, utf8, without

WINDOW = 10
BLOCK_WORDS = 50_000
MAX_SHARE = 0.5
OWN = ("n_words", "n_hit", "spans", "item_ids", "longest", "clean_text", "_found")

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Upper case to lower case, every other ASCII sign that is neither letter nor digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items whose windows end in a state.

    `window` consecutive words of an item are a window; an item of fewer words, but not none, is one window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, [self.code.setdefault(w, len(self.code)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # cut[v]: the state that holds the suffix of exactly `window` words of what v holds.
        self.cut = [self._down(v, window) for v in range(len(self.step))]
        self.items: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        for name, codes in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.step[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self.cut[v], set()).add(name)
            if len(codes) < window:
                short.setdefault(self._down(v, len(codes)), set()).add((len(codes), name))
        # Short items that are suffixes of what a state holds, longest states last so that links are done before.
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.step)
        for v in sorted(range(len(self.step)), key=self.length.__getitem__):
            above = self.short[self.link[v]] if self.link[v] >= 0 else ()
            self.short[v] = above + tuple(sorted(short.get(v, ())))

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        twin = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        return twin

    def _down(self, v: int, size: int) -> int:
        while self.link[v] >= 0 and self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Spans [first, end) of words in windows, the items with windows there, and the longest match.

        Walks once over the words; the length of the longest match that ends at each word is what the state and `n`
        hold.
        """
        step, link, length, short, window = self.step, self.link, self.length, self.short, self.window
        spans: list[list[int]] = []
        names: set[str] = set()
        v = n = longest = 0
        for i, c in enumerate(map(self.code.get, words)):
            if c is None:
                v = n = 0
                continue
            while v and c not in step[v]:
                v = link[v]
                n = length[v]
            if c in step[v]:
                v = step[v][c]
                n += 1
            else:
                n = 0
                continue
            if n > longest:
                longest = n
            size = 0
            if n >= window:
                names |= self.items.get(self.cut[v], set())
                size = window
            for m, name in short[v]:
                if m <= n:
                    names.add(name)
                    size = max(size, m)
            if size:
                first = i + 1 - size
                while spans and first <= spans[-1][1]:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return spans, names, longest


def joined(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_words(text: bytes, spans: list[list[int]]) -> bytes:
    """`text` with a line break in place of each span of words."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.translate(_FOLD))]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"\n".join([*parts, text[at:]])


_FOUND = "n_words:bigint, spans:array<array<int>>, items:array<string>, longest:int, clean:binary"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())),
        ("longest", pa.int32()), ("clean", pa.binary()),
    ]
)


def _matcher(shared):
    """Arrow function: texts and what earlier blocks of items found in them, to what is found so far."""

    def match(texts: pa.Array, before: pa.Array) -> pa.Array:
        automaton = shared.value
        out = []
        for text, old in zip(texts.to_pylist(), before.to_pylist()):
            words = words_of(text or b"")
            spans, names, longest = automaton.match(words)
            clean = (text if old is None else old["clean"]) or b""
            cuts = spans if old is None else automaton.match(words_of(clean))[0]
            while cuts:  # what a cut brings together may be a window again
                clean = cut_words(clean, cuts)
                cuts = automaton.match(words_of(clean))[0]
            if old is not None:
                spans = joined(spans + old["spans"])
                names |= set(old["items"])
                longest = max(longest, old["longest"])
            out.append(
                {
                    "n_words": len(words), "spans": spans, "items": sorted(names), "longest": longest,
                    "clean": None if text is None else clean,
                }
            )
        return pa.array(out, _ARROW)

    return match


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of about `block_words` words; the driver holds one block at a time."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    named = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    for name, text in items.select(named, utf8("text")).toLocalIterator():
        words = words_of(bytes(text or b""))
        block.append((name, words))
        held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block or not held:
        yield block


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows of `docs` with n_words, n_hit, spans, item_ids, longest and clean_text.

    Words: A-Z lower-cased runs of letters, digits and all characters beyond ASCII. A document word is hit if it lies
    in any occurrence of a window of an item. spans: maximal runs [first, end) of hit words; item_ids: items with
    occurring windows, sorted as strings; longest: the longest run of words shared with an item; clean_text: the text
    with a line break in place of every span, repeated until no window is left.

    The items are a stated query set, read in blocks of `block_words` words. Each block makes an automaton that is
    broadcast (its size follows from the block's) and passed over all documents; between blocks the state is written
    to the shared folder and the automaton dropped.

    Null texts have no words and a null clean_text; null item ids are named `null`; items without words never match.
    Repeated rows get equal results. Empty tables are fine on either side. Input columns named like a result column
    are replaced by it.
    """
    spark = docs.sparkSession
    kept = without(docs, OWN)
    rows = kept.withColumn("_found", F.lit(None).cast(f"struct<{_FOUND}>"))
    shared = None
    for block in item_blocks(items, block_words):
        if shared is not None:
            rows = stored(rows, "decontam")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        # A filter on the result must not work it out a second time.
        match = F.arrow_udf(_matcher(shared), f"struct<{_FOUND}>").asNondeterministic()
        rows = rows.withColumn("_found", match(utf8("text"), F.col("_found")))
    found = F.col("_found")
    hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return rows.select(
        *same(kept), found["n_words"].alias("n_words"), hit.alias("n_hit"), found["spans"].alias("spans"),
        found["items"].alias("item_ids"), found["longest"].alias("longest"),
        found["clean"].cast("string").alias("clean_text"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, max_share: float = MAX_SHARE, **how) -> DataFrame:
    """`docs` in their own columns without the spans of test items; documents with over `max_share` hit words go."""
    found = find(docs, items, **how).where(F.col("n_hit") <= max_share * F.col("n_words"))
    text = F.col("clean_text")
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return found.withColumns(new).select(*same(docs))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w
  FROM b WHERE len(w) > 0),
keys AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM windows),
spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM keys) WHERE len(w) >= size)),
found AS (SELECT doc_id, size, i, item_id FROM spots JOIN keys USING (size, s)),
hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY 1),
names AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS all_names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
       sha256(coalesce(all_names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""
