"""URL filters: a blocked Bloom filter of listed keys, and an exact hash join behind it.

A list has prefix rules (host and path) and canonical URLs. A URL has one key
per shape of rule and one for itself. Canonical keys that the filter lets
through are joined with the list exactly, so a false positive changes nothing.
A rule key may fit a great part of all pages; rules are looked up in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.tables import table
from fieldtally.session import settle

# (verdict, host, path): the rules every page is judged by.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Hosts whose pages make the list of blocked URLs in the ready-made query.
LISTED_HOSTS = ["spam-farm.example.org"]

BLOCK_BITS = 512
BITS_PER_KEY = 16
PROBES = 6
# A larger filter is joined by block like any table and not sent to every task.
BROADCAST_BYTES = 64 << 20
# Rules looked up in every task, and shapes of them: beyond either, rules are met by key.
BROADCAST_RULES = 50_000
LOOKUPS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    df = df.withColumn("__rest", rest).withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.substr(F.col("__rest"), F.length("__host") + 1), "^[^?#]*", 0)
    return df.withColumns({"host": F.translate("__host", _UPPER, _LOWER), "path": path}).drop("__rest", "__host")


# Escapes of letters, digits and - . _ ~, which mean the same written out (fixed by the URL standard).
_PLAIN_ESCAPE = "^%(2[DEde]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])"


def _unescaped(path: Column) -> Column:
    """Escapes of plain characters written out, all others in capitals."""

    def one(part: Column) -> Column:
        escape = F.substring(part, 1, 3)
        plain = F.char(F.conv(F.substring(part, 2, 2), 16, 10).cast("int"))
        changed = F.concat(F.when(part.rlike(_PLAIN_ESCAPE), plain).otherwise(F.upper(escape)), F.substr(part, F.lit(4)))
        return F.when(part.rlike("^%[0-9A-Fa-f]{2}"), changed).otherwise(part)

    parts = F.split(path, "(?=%[0-9A-Fa-f]{2})")
    return F.when(F.contains(path, F.lit("%")), F.array_join(F.transform(parts, one), "")).otherwise(path)


def _without_dots(path: Column) -> Column:
    """Segments . left out, segments .. with the one before them; never above the root."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    walked = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(walked, "/")).otherwise(path)


def canonical(host: str = "host", path: str = "path") -> Column:
    """One form of a URL's host and path; null without a host.

    User, port 80 or 443 and closing dots of the host go, plain escapes are
    written out, dot segments resolved, a closing slash goes.
    """
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:(80|443)?)?$", "")
    whole = F.regexp_replace(_without_dots(_unescaped(F.col(path))), "/$", "")
    return F.when(bare != "", F.concat(bare, whole))


def rule_entries(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """List entries of prefix rules; the longer rule ranks higher."""
    rows = [(h + p, len(h) + len(p), h + p, v, len(h.split(".")), len(p)) for v, h, p in rules]
    return spark.createDataFrame(rows, "key string, rank int, rule string, verdict string, labels int, prefix int")


def listed_entries(urls: DataFrame, verdict: str = "block") -> DataFrame:
    """List entries of canonical URLs (column url); they rank below every rule."""
    return urls.where("url IS NOT NULL").select(
        F.concat(F.lit("="), "url").alias("key"),
        F.lit(0).alias("rank"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(verdict).alias("verdict"),
        F.lit(None).cast("int").alias("labels"),
        F.lit(None).cast("int").alias("prefix"),
    ).distinct()


def _probes(key: str, n_blocks: int) -> dict[str, Column]:
    block = F.expr(f"pmod(xxhash64(`{key}`), {n_blocks}L)")
    return {"block": block, "__bits": F.xxhash64(F.lit(1), F.col(f"`{key}`"))}


def _bit(i: int) -> Column:
    """Place of probe ``i`` in its block: nine bits of the second hash."""
    return F.shiftright("__bits", 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


def bloom_blocks(keys: DataFrame, n_keys: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """The filter of column key, a row of eight words per used block, and the number of blocks."""
    n_blocks = max(1, -(-n_keys * bits_per_key // BLOCK_BITS))
    probed = keys.select("key").withColumns(_probes("key", n_blocks))
    bits = probed.select("block", F.explode(F.array(*[_bit(i) for i in range(PROBES)])).alias("bit"))
    words = [
        F.coalesce(F.bit_or(F.expr(f"IF(bit div 64 = {w}, shiftleft(1L, bit % 64), 0L)")), F.lit(0)).alias(f"w{w}")
        for w in range(BLOCK_BITS // 64)
    ]
    return bits.groupBy("block").agg(*words), n_blocks


def possible(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and a few that are not."""
    if n_blocks * (BLOCK_BITS // 8 + 8) <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    word = "element_at(array(w0, w1, w2, w3, w4, w5, w6, w7), shiftright({0}, 6) + 1)"
    probed = df.withColumns(_probes(key, n_blocks)).withColumns({f"__p{i}": _bit(i) for i in range(PROBES)})
    joined = probed.join(blocks, "block")
    for i in range(PROBES):
        joined = joined.where(f"{word.format(f'__p{i}')} & shiftleft(1L, __p{i} % 64) <> 0")
    return joined.select(*df.columns)


def _shape_key(labels: int, prefix: int) -> Column:
    """What a rule of so many host labels and path characters would have to be called to fit."""
    fits = (F.col("host") != "") & (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= prefix)
    return F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, prefix)))


def _with_rule(parted: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """``parted`` (with __id_url, host, path) and __rule, the struct of the longest fitting rule or null.

    Up to ``BROADCAST_RULES`` rules go to every task, one lookup per shape, and
    no page is shuffled: a rule that fits a third of the pages costs no more
    than another. More rules are met by key behind a filter, once per URL.
    """
    # Shapes: labels of the host times characters of the path, as many as rules differ in.
    shapes = sorted(tuple(r) for r in rules.select("labels", "prefix").distinct().collect())
    hit = F.struct("rank", "key", "rule", "verdict")
    if not shapes:
        return parted.withColumn("__rule", F.lit(None).cast("struct<rank:int,key:string,rule:string,verdict:string>"))
    if n_rules <= BROADCAST_RULES and len(shapes) <= LOOKUPS:
        for i, (k, n) in enumerate(shapes):
            own = rules.where(f"labels = {k} AND prefix = {n}").select(F.col("key").alias(f"__key_{i}"), hit.alias(f"__hit_{i}"))
            parted = parted.withColumn(f"__key_{i}", _shape_key(k, n)).join(F.broadcast(own), f"__key_{i}", "left")
        hits = [F.col(f"__hit_{i}") for i in range(len(shapes))]
        made = [f"__{c}_{i}" for c in ("key", "hit") for i in range(len(shapes))]
        return parted.withColumn("__rule", F.array_max(F.array(*hits))).drop(*made)
    blocks, n_blocks = bloom_blocks(rules, n_rules)
    keys = F.explode(F.array(*[_shape_key(k, n) for k, n in shapes]))
    probes = parted.select("__id_url", keys.alias("key")).where("key IS NOT NULL").distinct()
    met = possible(probes, "key", blocks, n_blocks).join(rules.hint("shuffle_hash"), "key")
    # Written, so that the join back is one of plain shuffles and a URL on many pages can be split.
    best = settle(met.groupBy("__id_url").agg(F.max(hit).alias("__rule")), "url-rules")
    return parted.join(best, "__id_url", "left")


def judge(pages: DataFrame, entries: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule fits its host and all hosts below it if the path starts with the
    rule's; the longest fitting one decides, on equal length the greater key.
    Without one, a listed canonical URL decides, else ``otherwise``; an entry
    given with two verdicts has the greater. Null, empty, odd and very long
    URLs are judged like any other; they fit no rule unless they have a host.
    Repeated pages are judged each, an empty table gives no rows, empty
    ``entries`` give ``otherwise``. ``entries`` may be of any size and may
    repeat. Only keys the filter lets through meet the list, each key once.
    Columns host, path, rule and verdict of ``pages`` are replaced, others of
    any name kept.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    entries = entries.groupBy("key", "rank", "rule", "labels", "prefix").agg(F.max("verdict").alias("verdict"))
    entries = settle(entries, "url-entries")
    n_keys, n_rules = entries.agg(F.count("*"), F.count("labels")).first()
    inner = pages.select(*[F.col(f"`{c}`") for c in kept]).toDF(*[f"__kept_{i}" for i in range(len(kept))])
    parted = with_parts(inner, f"__kept_{kept.index(url)}").withColumn("__id_url", F.col(f"__kept_{kept.index(url)}"))
    ruled = _with_rule(parted, entries.where("labels IS NOT NULL"), n_rules)
    verdict = F.col("__rule.verdict")
    if n_keys > n_rules:
        listed = entries.where("labels IS NULL")
        blocks, n_blocks = bloom_blocks(listed, n_keys - n_rules)
        ruled = ruled.withColumn("__listed", F.when(F.col("__rule").isNull(), F.concat(F.lit("="), canonical())))
        keys = ruled.select(F.col("__listed").alias("key")).where("key IS NOT NULL")
        met = possible(keys, "key", blocks, n_blocks).distinct().join(listed.hint("shuffle_hash"), "key")
        met = settle(met.select(F.col("key").alias("__listed"), F.col("verdict").alias("__by_list")), "url-hits")
        ruled = ruled.join(met, "__listed", "left")
        verdict = F.coalesce(verdict, "__by_list")
    return ruled.select(
        *[F.col(f"__kept_{i}").alias(c) for i, c in enumerate(kept)],
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(verdict, F.lit(otherwise)).alias("verdict"),
    )


def listed_urls(pages: DataFrame, hosts: list[str] = LISTED_HOSTS) -> DataFrame:
    """Canonical URLs of the pages on the given hosts."""
    return with_parts(pages.select("url")).where(F.col("host").isin(hosts)).select(canonical().alias("url"))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by the rules and by the listed URLs."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    entries = rule_entries(spark).unionByName(listed_entries(listed_urls(pages)))
    return judge(pages, entries).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP8_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS r, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
p AS (SELECT r, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, host, path) AS (VALUES {_RULES_SQL}),
fits AS (SELECT p.r, rules.host || rules.path AS rule, rules.verdict,
    row_number() OVER (PARTITION BY p.r ORDER BY length(rules.host) + length(rules.path) DESC) AS place
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)),
steps AS (SELECT r, host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:(80|443)?)?$', '') AS bare,
    string_split(list_aggregate(list_prepend('', list_transform(
      regexp_extract_all(path, '%[0-9A-Fa-f][0-9A-Fa-f]|[^%]+|%'), lambda x:
        CASE WHEN regexp_matches(x, '{_PLAIN_ESCAPE}$') THEN chr(('0x' || substr(x, 2))::INT)
             WHEN regexp_matches(x, '^%[0-9A-Fa-f][0-9A-Fa-f]$') THEN upper(x) ELSE x END)), 'string_agg', ''), '/') AS parts FROM p),
keys AS (SELECT r, host, bare || regexp_replace(list_reduce(parts, lambda a, x: CASE WHEN x = '.' THEN a
    WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END), '/$', '') AS key FROM steps WHERE bare <> ''),
listed AS (SELECT DISTINCT key FROM keys WHERE host IN ('spam-farm.example.org'))
SELECT page_id, p.host, p.path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fits ON fits.r = p.r AND place = 1 LEFT JOIN keys ON keys.r = p.r LEFT JOIN listed ON listed.key = keys.key
"""
