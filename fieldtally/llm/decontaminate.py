"""Benchmark decontamination: a generalised suffix automaton of test items read along every text.

The automaton knows every run of words of the items. A text's words are fed
through it one by one; the state tells how long a run ending here also stands
in an item, so a run of ``window`` words, or a whole shorter item, is found in
one pass whatever the number of items.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.tables import map_texts, shielded, table
from fieldtally.session import release, scratch_path, settle

WINDOW = 13
# Bound of one automaton: about 70 MB in a task. More items make more automata, each read along all texts.
BLOCK_WORDS = 100_000
# Automata that one stage reads along the texts; what they found is stored before the next ones.
CHAIN = 4
# A text is cut into words a piece of about this many bytes at a time, so a very long one never lies there as a list.
PIECE_BYTES = 1 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same on UTF-8: A-Z lower-cased, whatever is no part of a word a space. Bytes from 128 up are parts of letters.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> Iterator[re.Match]:
    """Matches of the words of a text, with their places."""
    return re.finditer(WORD, (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size."""
    spaced = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    at = 0
    while at < len(spaced):
        end = len(spaced) if len(spaced) - at <= PIECE_BYTES else spaced.find(b" ", at + PIECE_BYTES)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


class Automaton:
    """Suffix automaton over word sequences, with the items of each window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[tuple[str | None, list[bytes]]] = []
        self.n_words = 0

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the runs of ``q`` that end at a step from ``p``; q itself if it holds no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, item_id: str | None, item: list[bytes]) -> None:
        """Add an item's words; an item without words adds nothing."""
        if not item:
            return
        self.items.append((item_id, item))
        self.n_words += len(item)
        last = 0
        for word in item:
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
                continue
            state = self._state(self.length[last] + 1, 0, {})
            p, last = last, state
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                self.link[state] = self._split(p, word, self.next[p][word])

    def close(self) -> Automaton:
        """Note for every state the window that ends there, and the whole short items."""
        n, w = len(self.next), self.window
        found: list[set] = [set() for _ in range(n)]
        self.whole: list[list] = [[] for _ in range(n)]
        for item_id, item in self.items:
            state = 0
            for i, word in enumerate(item):
                state = self.next[state][word]
                size = w if i + 1 >= w else len(item) if i + 1 == len(item) else 0
                if size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    if size == w:
                        found[at].add(item_id)
                    elif (size, item_id) not in self.whole[at]:
                        self.whole[at].append((size, item_id))
        # A state of w words or more belongs to one window: its suffix of w words.
        self.ends = [-1] * n
        self.shorter = [-1] * n  # nearest shorter suffix that holds a whole short item
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= w:
                self.ends[state] = state if self.length[up] < w else self.ends[up]
            self.shorter[state] = up if up > 0 and self.whole[up] else self.shorter[up] if up > 0 else -1
        self.found = {s: sorted(x, key=str) for s, x in enumerate(found) if x}
        self.short = [bool(self.whole[s]) or self.shorter[s] >= 0 for s in range(n)]
        # The least matched length at which anything can end.
        self.least = min([w, *(len(i) for _, i in self.items)], default=w)
        self.items = []
        return self

    def parts(self) -> tuple:
        """What reading needs, in plain lists and dictionaries."""
        return (self.next, self.link, self.length, self.ends, self.found, self.short, self.whole, self.shorter, self.window, self.least)

    def read(self, text: str | None) -> tuple[int, list[int], set]:
        """See ``read_along``."""
        return read_along(self.parts(), text)


def read_along(automaton: tuple, text: str | None) -> tuple[int, list[int], set]:
    """Number of words, merged hit runs as [first, last, first, last ...] in words, and ids of the items found."""
    follow, link, length, ends, found, short, whole, shorter, w, least = automaton
    runs: list[int] = []
    items: set = set()
    state = matched = n = 0
    for run in word_runs(text):
        for i, word in enumerate(run, n):
            to = follow[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = follow[state].get(word)
            if to is None:
                continue
            state = to
            matched += 1
            if matched < least:
                continue
            size = 0
            if matched >= w:
                size = w
                items.update(found[ends[state]])
            if short[state]:
                at = state
                while at >= 0:
                    for k, item_id in whole[at]:
                        if k <= matched:
                            size = max(size, k)
                            items.add(item_id)
                    at = shorter[at]
            if size:
                first = i - size + 1
                while runs and first <= runs[-1] + 1:
                    first = min(first, runs[-2])
                    del runs[-2:]
                runs += (first, i)
        n += len(run)
    return n, runs, items


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(words, block): automata over all of ``items`` (item_id, text), each over at most ``block_words`` words or one item.

    Tasks build and store them, in a form that needs no class of this package;
    the driver counts words and sees no item.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: Automaton) -> pa.RecordBatch:
            made = pickle.dumps(block.close().parts(), pickle.HIGHEST_PROTOCOL)
            return pa.RecordBatch.from_arrays([pa.array([block.n_words]), pa.array([made], pa.large_binary())], names=["words", "block"])

        block = Automaton(window)
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = [w for run in word_runs(text) for w in run]
                if block.n_words and block.n_words + len(item) > block_words:
                    yield told(block)
                    block = Automaton(window)
                block.add(item_id, item)
        if block.n_words:
            yield told(block)

    given = settle(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")), "benchmark-items")
    # A word takes two bytes at least, one of them the space.
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A task makes one automaton at least, so there are no more tasks than the words fill automata.
    dealt = given.repartition(max(1, size // (8 * block_words)))
    return settle(dealt.mapInArrow(build, "words long, block binary"), "benchmark-automata")


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_runs", T.ArrayType(T.IntegerType())),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    cut: bool = False,
) -> DataFrame:
    """``docs`` with n_words, hit_runs (merged runs of hit words, first and last in turn) and hit_items.

    Nothing is dropped: each block of items is read along all texts and the
    runs of several blocks are joined. A null or empty text has no words. An
    item of null text has no words and is found nowhere; an item without id
    makes hits but is not listed; an item given twice is listed once. A very
    long text is read as a stream of words. Ties do not arise. With ``cut`` the
    runs are taken out of the texts that are not contaminated. Columns of the
    added names are replaced. Without items, or without documents, nothing is found.
    """
    spark, found, before = docs.sparkSession, docs, None
    stored = automata(items, window, block_words)
    n_blocks = stored.count()
    for i, row in enumerate(stored.select("block").toLocalIterator()):
        last = i == n_blocks - 1
        begin = _reading(docs.sparkSession.sparkContext.broadcast(bytes(row[0])), i > 0, text if cut and last else None)
        added = [*FOUND.fields, *([T.StructField(text, T.StringType())] if cut and last else [])]
        found = map_texts(found, text, begin, T.StructType(added), found.columns)
        if not last and i % CHAIN == CHAIN - 1:
            # A stage holds so many automata at a time; only what the last stage found is kept.
            path = scratch_path(spark, "benchmark-found")
            found.write.parquet(path)
            found = spark.read.schema(found.schema).parquet(path)
            if before:
                release(spark, before)
            before = path
    if not n_blocks:
        begin = _reading(docs.sparkSession.sparkContext.broadcast(pickle.dumps(Automaton(window).close().parts())), False, None)
        found = map_texts(found, text, begin, FOUND, found.columns)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in FOUND.names], *FOUND.names)


def _reading(shared, had: bool, cut: str | None):
    """Function of a task that reads one automaton along texts, on top of what earlier ones found; ``cut`` names the text to cut."""

    def begin():
        automaton = pickle.loads(shared.value)

        def work(texts: list, rows: pa.RecordBatch) -> dict:
            found = [read_along(automaton, t) for t in texts]
            runs, items = [r[1] for r in found], [sorted(x for x in r[2] if x is not None) for r in found]
            if had:
                runs = [joined(a, b) for a, b in zip(runs, rows.column("hit_runs").to_pylist(), strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, rows.column("hit_items").to_pylist(), strict=True)]
            made = {"n_words": [r[0] for r in found], "hit_runs": runs, "hit_items": items}
            if cut:
                kept = zip(texts, made["n_words"], runs, strict=True)
                made[cut] = [cut_runs(t, r) if r and not _covered(n, r) else t for t, n, r in kept]
            return made

        return work

    return begin


def joined(a: list[int], b: list[int]) -> list[int]:
    """Two lists of runs as one list of runs that neither touch nor overlap."""
    out: list[int] = []
    for first, last in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += (first, last)
    return out


def _covered(n_words: int, runs: list[int]) -> bool:
    """Whether the runs cover a twentieth of the words or more."""
    hit = sum(runs[1::2]) - sum(runs[::2]) + len(runs) // 2
    return hit > 0 and 20 * hit >= n_words


def n_hit(runs: str = "hit_runs") -> Column:
    """Number of words in the runs."""
    plus_one = F.aggregate(F.col(runs), F.lit(0).cast("long"), lambda acc, x: x.cast("long") - acc)
    return plus_one + (F.size(runs) / 2).cast("long")


def contaminated(words_col: str = "n_words", hit: Column | None = None) -> Column:
    """A text is contaminated when a twentieth of its words or more is hit."""
    hit = n_hit() if hit is None else hit
    return (hit > 0) & (hit * 20 >= F.col(words_col))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; runs of hit words in the others are cut out of the text.

    The coverage limit takes the whole text, the length limit (``window``
    words) takes the run. Texts without a hit stay as they are, null included,
    and so do all other columns, whatever their names.
    """
    shield, named = shielded(docs, text)
    made = scan(shield, items, text, cut=True).where(~contaminated())
    return made.select(*named(made))


def cut_runs(text: str, runs: list[int]) -> str:
    """The text without the runs of words."""
    edges = set(runs[::2]), set(runs[1::2])
    out, at, start = [], 0, 0
    for i, m in enumerate(words(text)):
        if i in edges[0]:
            start = m.start()
        if i in edges[1]:
            out.append(text[at:start])
            at = m.end()
    return "".join(out) + text[at:]


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words, items found and the verdict for every document against all benchmark items."""
    found = scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    hit = found.withColumn("n_hit", n_hit())
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        contaminated(hit=F.col("n_hit")).alias("contaminated"),
    )


WORDS_SQL = rf"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"""

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, i, runs.n, item_id FROM runs JOIN windows ON runs.n = windows.n AND runs.run = windows.run),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
