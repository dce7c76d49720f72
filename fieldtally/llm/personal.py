"""Personal data: seed entities by pattern, and more of them by bootstrapping over their contexts.

Seeds (mail, network and card numbers, phones) are found by fixed patterns.
The words around them become lexical patterns; a table of patterns and the
number-like strings they surround is scored in rounds, patterns by the known
identifiers in their place against what speaks against them, strings by their
patterns, until a round adds nothing. Strings that end up sure enough are
personal data wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.tables import map_texts, shielded, table
from fieldtally.session import scratch_path, settle

KINDS = ["email", "ip", "card", "phone"]

# A pattern needs this many different known strings, and this share of them among all that say something about it.
MIN_KNOWN, MIN_SHARE = 4, 0.9
# Where unknown strings outnumber known ones, a string needs this many different contexts.
MIN_CONTEXTS = 2
# A string is taken for an identifier from this confidence up.
MIN_SURE = 0.9
# Unknown words and runs of number groups that can be identifiers: this long, with so many digits. Words like addresses need neither.
MIN_LENGTH, MIN_DIGITS = 6, 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# The patterns of the contract, with possessive runs so that long runs of digits cost no second try.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What unknown identifiers can look like besides: groups of digits joined by the separators of cards and phones, ...
_GROUPS = re.compile(r"(?<![^\W_])\+?\(?[0-9]++(?:[\x20().-]++[0-9]++)++")
# ... and words with something on both sides of an at sign, or of its usual disguises.
_AT = re.compile(r"@|[\[({<]at[\])}>]", re.IGNORECASE)
_AT_SPARK = r"(?i)@|[\[({<]at[\])}>]"
_TOKEN = re.compile(r"\S+")
_TRIM = "\"'()[]{}<>,;:!?.*#$%&|=/\\"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost mail addresses, one look at every @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        # A part of more digits than three is small only with zeros before it.
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the seeds of a text, by kind as listed and then by start."""
    if not text:
        return []
    found = zip(KINDS, (emails, addresses, cards, phones), strict=True)
    return [(kind, a, b) for kind, spans in found for a, b in spans(text)]


def places(text: str | None, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str | None, int, int, str, str, str]]:
    """(kind or None, start, end, string, word before, word after) of seeds and of strings like identifiers that are none.

    Words of context are lower-cased; a text's edge is an empty word. Runs of
    number groups are given as a whole, and those of their words that can be identifiers too.
    """
    if not text or not spans and not any(c.isdigit() for c in text) and not _AT.search(text):
        return
    seeds = sorted((a, b, kind) for kind, a, b in spans)
    runs = _runs(text, seeds)
    run = next(runs, None)
    at = 0
    before: str = ""
    pending: list = []
    for m in _TOKEN.finditer(text):
        word = m[0]
        if pending:
            for p in pending:
                yield (*p, _context(word))
            pending = []
        while run and run[0] < m.end():
            yield None, *run, text[run[0] : run[1]], before, _context(_word_at(text, run[1]))
            run = next(runs, None)
        while at < len(seeds) and seeds[at][1] <= m.start():
            at += 1
        if at < len(seeds) and seeds[at][0] < m.end():
            held = False
            k = at
            while k < len(seeds) and seeds[k][0] < m.end():
                a, b, kind = seeds[k]
                if m.start() <= a:
                    if b <= m.end():
                        pending.append((kind, a, b, text[a:b], before))
                    else:  # ends in a later word: its right context is not this word
                        yield kind, a, b, text[a:b], before, _context(_word_at(text, b))
                held = True
                k += 1
            before = "" if held else _context(word)
            continue
        digits = sum(c.isdigit() for c in word)
        address = _address(word)
        if digits >= MIN_DIGITS or address:
            a, b = m.start(), m.end()
            while a < b and text[a] in _TRIM:
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            if b - a >= MIN_LENGTH or address:
                pending.append((None, a, b, text[a:b], before))
                before = ""
                continue
        before = _context(word)
    for p in pending:
        yield (*p, "")


def _runs(text: str, seeds: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs of number groups over several words, between the seeds."""
    free = 0
    for a, b, _ in [*seeds, (len(text), len(text), "")]:
        for m in _GROUPS.finditer(text, free, a) if a > free else ():
            run = m[0]
            if text[m.end() : m.end() + 1].isalnum():  # the last group is part of a word
                run = run.rstrip("0123456789").rstrip(" ().-")
            if " " in run and len(run) >= MIN_LENGTH and sum(c.isdigit() for c in run) >= MIN_DIGITS:
                yield m.start(), m.start() + len(run)
        free = max(free, b)


def _address(word: str) -> bool:
    """Whether a word has the shape of a mail address."""
    at = _AT.search(word)
    return at is not None and any(map(str.isalnum, word[: at.start()])) and any(map(str.isalnum, word[at.end() :]))


def _word_at(text: str, at: int) -> str:
    m = _TOKEN.search(text, at)
    return m[0] if m else ""


def _context(word: str) -> str:
    """A word as context: lower-cased, numbers masked, at most 32 characters of it."""
    # One digit after a letter is part of a name (line1, eth0); other digits are any number.
    return re.sub(r"\d\d+|(?<![^\W\d_])\d", lambda m: "9" * len(m[0]), word[:32].lower())


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_PLACE = T.StructType(
    [*_SPAN.fields, T.StructField("string", T.StringType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]
)


def seeds(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with base (spans), places (of seeds and number-like strings) and digest, a key of the text."""

    def begin():
        def work(texts: list, _) -> dict:
            base = [base_spans(t) for t in texts]
            return {
                "base": [[(KINDS.index(k), a, b) for k, a, b in spans] for spans in base],
                "places": [
                    [(None if k is None else KINDS.index(k), *rest) for k, *rest in places(t, spans)]
                    for t, spans in zip(texts, base, strict=True)
                ],
            }

        return work

    added = T.StructType([T.StructField("base", T.ArrayType(_SPAN)), T.StructField("places", T.ArrayType(_PLACE))])
    keep = docs.columns if keep is None else keep
    marked = docs.withColumn("__digest", F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))
    return map_texts(marked, text, begin, added, [*keep, "__digest"]).withColumnRenamed("__digest", "digest")


def shape(string: str = "string") -> Column:
    """What a string looks like: what has known ones of another shape only is never found.

    Words like addresses are one shape, and so are digits and groups of them
    joined by the separators of cards and phones. Of all others every run of
    letters is one letter and every run of digits one digit.
    """
    s = F.col(string)
    fine = F.regexp_replace(F.regexp_replace(s, r"\p{L}+", "a"), r"\d+", "9")
    groups = s.rlike(r"^[0-9\x20().+-]+$") & ~s.rlike(r"^[0-9]+(\.[0-9]+)+$")
    return F.when(s.rlike(_AT_SPARK), "@").when(groups, "#").otherwise(fine)


def sure_strings(places_: DataFrame) -> DataFrame:
    """(string, kind, sure) of unknown strings taken for identifiers, from ``places_`` (kind, string, before, after).

    A pattern is the word before a place, the word after it, or both, each with
    the shape of the string in it. Every round scores the table of patterns and strings:

    - A pattern is of the kind it knows most different strings of (ties: the
      kind listed first), and needs MIN_KNOWN of them. Against it speak strings
      known as another kind beside the same words, whatever their shape (so a
      word as common as "the" spreads nothing), and unknown strings that mostly
      stand elsewhere: more than half of their contexts lie in no pattern that
      knows enough of that kind. It is good if what it knows is MIN_SHARE of
      that, or of all strings in it.
    - A good pattern is crowded if it has more unknown strings than known ones:
      what fills such a place need not be an identifier, so it counts only for
      strings that stand in two different contexts of good patterns of that kind.
    - An unknown string is scored by 1 minus the product of the doubts of its
      good patterns that count, and is sure from MIN_SURE.

    What is sure stays so and counts as known in the next round; the rounds end
    when one adds nothing. All counts are of different strings over the whole
    table, reduced before they are shuffled.
    """
    spark = places_.sparkSession
    form = shape()
    context = F.concat_ws("\u0001", "before", "after")
    around = F.array(
        F.concat_ws("\u0001", F.lit("b"), "before", form),
        F.concat_ws("\u0001", F.lit("a"), "after", form),
        F.concat_ws("\u0001", F.lit("c"), "before", "after", form),
    )
    contexts = places_.where("before <> '' OR after <> ''").groupBy("string", "before", "after").agg(F.min("kind").alias("kind"))
    edges = settle(contexts.select(F.explode(around).alias("pattern"), context.alias("context"), "string", "kind"), "pattern-edges")
    unknown = edges.where("kind IS NULL")
    sizes = settle(edges.groupBy("pattern").agg(F.count_distinct("string").alias("strings")), "pattern-sizes")
    stands = settle(unknown.groupBy("string").agg((F.count("*") / 3).cast("long").alias("contexts")), "pattern-stands")
    kinds = range(len(KINDS))
    paths: list[str] = []
    while True:
        known = edges
        if paths:
            names = spark.read.parquet(*paths).select(F.col("string").alias("__s"), F.col("kind").alias("__k"))
            known = edges.join(names, F.col("string") == F.col("__s"), "left").withColumn("kind", F.coalesce("kind", "__k")).drop("__s", "__k")
        held = known.where("kind IS NOT NULL").groupBy("pattern", "string").agg(F.min("kind").alias("kind"))
        patterns = held.groupBy("pattern").agg(F.count("*").alias("held"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in kinds])
        most = F.greatest(*[F.col(f"n{k}") for k in kinds])
        kind = reduce(lambda rest, k: F.when(F.col(f"n{k}") == F.col("most"), k).otherwise(rest), reversed(kinds), F.lit(None))
        patterns = patterns.withColumn("most", most).where(F.col("most") >= MIN_KNOWN)
        patterns = patterns.select("pattern", kind.cast("int").alias("of"), "most", "held")
        # The words of a pattern, without the shape.
        parts = F.split("pattern", "\u0001")
        word = F.array_join(F.slice(parts, 1, F.when(F.col("pattern").startswith("c"), 3).otherwise(2)), "\u0001")
        beside = held.select(word.alias("word"), "string", "kind").distinct().groupBy("word", "kind").agg(F.count("*").alias("known"))
        other = F.sum(F.when(F.col("kind") != F.col("of"), F.col("known")).otherwise(0))
        able = patterns.withColumn("word", word).join(beside, "word").groupBy("pattern", "of", "most", "held").agg(other.alias("other"))
        able = able.join(sizes, "pattern").withColumn("plain", F.col("most") / F.col("strings"))
        able = able.where((F.col("most") >= MIN_SHARE * (F.col("most") + F.col("other"))) | (F.col("plain") >= MIN_SHARE))
        crowded = F.col("strings") - F.col("held") > F.col("most")
        able = settle(able.select("pattern", "of", "most", "other", "plain", crowded.alias("crowded")), "pattern-able")
        left = unknown.join(spark.read.parquet(*paths), "string", "left_anti") if paths else unknown
        met = settle(left.drop("kind").join(able, "pattern"), "pattern-met")
        inside = met.groupBy("string", "of").agg(F.count_distinct("context").alias("inside"))
        strange = inside.join(stands, "string").where("2 * inside < contexts").select("string", "of")
        against = met.select("pattern", "of", "string").distinct().join(strange, ["string", "of"]).groupBy("pattern").agg(F.count("*").alias("against"))
        spoken = F.col("most") / (F.col("most") + F.col("other") + F.coalesce("against", F.lit(0)))
        good = able.join(against, "pattern", "left").withColumn("share", F.greatest(spoken, "plain")).where(F.col("share") >= MIN_SHARE)
        # A share is never certain.
        good = good.select("pattern", (1 - F.col("share") * 0.99).alias("doubt"))
        scored = met.join(good, "pattern")
        seen = scored.groupBy("string", "of").agg(F.count_distinct("context").alias("seen"))
        once = scored.select("pattern", "of", "string", "crowded", "doubt").distinct().join(seen, ["string", "of"])
        counts = once.where(~F.col("crowded") | (F.col("seen") >= MIN_CONTEXTS))
        by_kind = counts.groupBy("string", "of").agg((1 - F.exp(F.sum(F.log("doubt")))).alias("sure"))
        best = by_kind.groupBy("string").agg(F.max(F.struct("sure", (-F.col("of")).alias("k"))).alias("b"))
        sure = best.select("string", (-F.col("b.k")).alias("kind"), F.col("b.sure").alias("sure")).where(f"sure >= {MIN_SURE}")
        path = scratch_path(spark, "sure-strings")
        sure.write.parquet(path)
        paths.append(path)
        if spark.read.parquet(path).isEmpty():
            return spark.read.parquet(*paths)


def found_spans(seeded: DataFrame) -> DataFrame:
    """(digest, found): spans of the strings that the bootstrapping found, per text that has one.

    ``seeded`` (digest, places) is read several times and should be stored.
    Equal texts count once.
    """
    rows = seeded.where("size(places) > 0").dropDuplicates(["digest"])
    listed = settle(rows.select("digest", F.explode("places").alias("p")).select("digest", "p.*"), "personal-places")
    sure = sure_strings(listed.select("kind", "string", "before", "after"))
    unknown = listed.where("kind IS NULL").select("digest", "string", "start", "end")
    hits = unknown.join(sure.select("string", "kind"), "string")
    # What lies within a longer string that is found is not told again.
    ahead = Window.partitionBy("digest").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("upto", F.max("end").over(ahead)).where("upto IS NULL OR end > upto")
    return hits.groupBy("digest").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))


def with_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with base and spans: (kind number, start, end) of the seeds, and of all personal data.

    Offsets are in code points, ends exclusive. Null and empty texts have no
    spans, and an empty table gives no rows. Very long texts are read whole.
    Equal texts have equal spans and count once as evidence; repeated rows stay.
    A string that two kinds claim alike is of the kind listed first. Columns
    called base or spans are replaced, others may have any name. The spans
    found by bootstrapping never meet a seed's.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "spans")]
    shield, named = shielded(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__read")), "__read")
    seeded = settle(seeds(shield, "__read", shield.columns[:-1]), "personal-seeds")
    found = found_spans(seeded.select("digest", "places")).withColumnRenamed("digest", "__d")
    joined = seeded.join(found, F.col("digest") == F.col("__d"), "left")
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    spans = F.array_sort(F.concat("base", F.coalesce("found", empty)))
    out = joined.withColumns({"base": F.array_sort("base"), "spans": spans, "__read": F.lit(None)})
    return out.select(*named(out)[:-1], "base", "spans")


def written(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts and digest of the seeds, and all spans."""
    found = with_spans(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans")
    )


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    Where spans overlap, the first of them is replaced and the rest of the
    others cut; of equal starts the shorter names it. An empty table stays one, a very
    long text is masked whole. Texts without a span, null ones included, stay as they are, and
    so do all other columns, whatever their names.
    """
    seeded = settle(seeds(docs.select(F.col(f"`{text}`")), text, []), "personal-seeds")
    found = settle(found_spans(seeded.select("digest", "places")), "personal-found")
    shield, named = shielded(docs, text)
    marked = shield.withColumn("__digest", F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    if not found.isEmpty():
        marked = marked.join(found.toDF("__d", "__found"), F.col("__digest") == F.col("__d"), "left")
    has_found = "__found" in marked.columns

    def begin():
        def work(texts: list, rows) -> dict:
            found = rows.column("__found").to_pylist() if has_found else [None] * len(texts)
            return {text: [masked(t, more) for t, more in zip(texts, found, strict=True)]}

        return work

    added = T.StructType([T.StructField(text, T.StringType())])
    made = map_texts(marked, text, begin, added, marked.columns)
    return made.select(*named(made))


def masked(text: str | None, found: list[dict] | None) -> str | None:
    """A text with its seeds and the given further spans replaced by their kinds."""
    spans = [(a, b, k) for k, a, b in base_spans(text)] + [(s["start"], s["end"], KINDS[s["kind"]]) for s in found or ()]
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]
