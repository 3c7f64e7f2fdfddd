"""URL verdicts: rules by longest prefix, and a block list behind a cascade of Bloom filters.

The cascade answers exactly for every key of a known universe. Its first filter encodes the listed keys; the second
encodes the other keys of the universe that the first lets through, the third the listed keys that the second lets
through, and so on until a level lets nothing through by mistake. The first level's error rate follows from the sizes
of list and universe, so the false positives, and with them all later levels, stay about as few as the listed keys.

Keys are domains and page addresses (host and path). A filter is a binary literal of seven bits a byte, put together on
the executors as bitmaps. A list whose filters would grow beyond ``MOST_BITS`` is cut by key hash into shards, each with a
cascade of its own and a pass over the urls of its own, so a query never carries more than that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from understory.session import written

#: Host or parent domain (or ``top/`` suffix), path prefix, verdict.
Rule = tuple[str, str, str]
#: Bits of a first level beyond which a list is cut into shards (seven bits a byte: about 9.6 MB).
MOST_BITS = 1 << 26
LEVELS = 60
#: Bytes of a bitmap of the built-in bitmap functions.
BITMAP = 4_096
#: For each level the filter as a literal, its bits and its hashes.
Levels = list[tuple[Column, int, int]]


def host_of(url: Column) -> Column:
    """What stands from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1)


def rule_name(rule: Rule) -> str:
    return rule[0] + rule[1]


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict, or NULL; of equally long ones the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(enumerate(rules), key=lambda x: (len(rule_name(x[1])), -x[0]))
    for _, rule in order:
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        found = F.when(fits, F.struct(F.lit(rule_name(rule)).alias("rule"), F.lit(rule[2]).alias("verdict"))).otherwise(found)
    return found


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def may_hold(key: Column, level: int, filter_: tuple[Column, int, int]) -> Column:
    """Whether a filter (literal, bits, hashes) may hold the key."""
    packed, bits, hashes = filter_
    test = F.lit(True)
    for at in _positions(key, level, bits, hashes):
        byte = F.substring(packed, (F.floor(at / 7) + 1).cast("int"), F.lit(1))
        test = test & (F.getbit(F.ascii(byte.cast("string")).cast("int"), F.pmod(at, F.lit(7)).cast("int")) == 1)
    return test


def _bits(n: int, error: float) -> int:
    return max(8, math.ceil(-n * math.log(error) / math.log(2) ** 2))


def _first_error(n: int, others: int) -> float:
    return min(0.5, n / max(1, others) / math.sqrt(2)) if n else 0.5


def bloom(keys: DataFrame, n: int, error: float, level: int) -> tuple[Column, int, int]:
    """A filter over ``n`` keys. Executors aggregate bitmaps of 4 KB; those that are not empty reach the driver.

    Seven of eight bits are used, so that each byte is an ASCII character, which built-in functions read back as a number.
    """
    bits = _bits(n, error)
    hashes = max(1, round(bits / n * math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at"))
    place = at.select((F.floor(F.col("at") / 7) * 8 + F.pmod(F.col("at"), F.lit(7)) + 1).alias("place"))
    made = bytearray(-(-bits // 7))
    # Not an iterator of partitions, which would start a job for each of them; all bitmaps together are MOST_BITS at most.
    for row in place.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")).collect():
        start = (row["b"] - 1) * BITMAP
        made[start:start + BITMAP] = row["bitmap"][:len(made) - start]
    return F.lit(bytes(made)), bits, hashes


def marked_keys(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """``key, on``: every key of the universe once, and whether it is listed; told apart by one grouping, without a join."""
    keys = universe.select("key", F.lit(False).alias("on")).union(listed.select("key", F.lit(True)))
    return written(keys.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.max("on").alias("on"), F.max(~F.col("on")).alias("here")).filter("here").select("key", "on"), "url-keys")


def _sizes(marked: DataFrame) -> tuple[int, int]:
    row = marked.agg(F.count_if("on").alias("n"), F.count_if(~F.col("on")).alias("others")).first()
    return row["n"], row["others"]


def _levels(marked: DataFrame) -> Levels:
    n, others = _sizes(marked)
    levels: Levels = []
    left = marked
    error = _first_error(n, others)
    while n:
        if len(levels) == LEVELS:
            raise ValueError("the cascade does not end; are there keys with equal hashes?")
        here = len(levels)
        inside = here % 2 == 0
        levels.append(bloom(left.filter(F.col("on") == inside), n, error, here))
        # Of the inside keys all pass; of the others the false positives go on to the next level, with all inside keys.
        passed = may_hold(F.col("key"), here, levels[-1])
        # They are written, so that no level tests the filters of all levels before it again.
        left = written(left.filter((F.col("on") == inside) | passed), "url-left")
        n = left.filter(F.col("on") != inside).count()
        error = 0.5
    return levels


def cascade(universe: DataFrame, listed: DataFrame) -> Levels:
    """The levels for the column ``key`` of ``universe`` (all keys of the corpus) and ``listed``; NULL keys take no part.

    Both tables may repeat keys; listed keys outside the universe need no bits. Each level's survivors are written for
    the next one.
    """
    return _levels(marked_keys(universe, listed))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def cascades(universe: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> list[Levels]:
    """One cascade for each shard of the keys, in the order of ``shard_of``; one shard unless the list is large."""
    marked = marked_keys(universe, listed)
    n, others = _sizes(marked)
    shards = max(1, -(-_bits(n, _first_error(n, others)) // most_bits)) if n else 1
    if shards == 1:
        return [_levels(marked)]
    return [_levels(marked.filter(shard_of(F.col("key"), shards) == s)) for s in range(shards)]


def listed_in(key: Column, levels: Levels) -> Column:
    """Exact membership for any key of the universe: the first level that says no decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        answer = F.when(may_hold(key, level, levels[level]), answer).otherwise(F.lit(level % 2 == 1))
    return answer


def suffixes(host: Column) -> Column:
    """A host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def keys_of(host: Column, path: Column) -> Column:
    """What a list may hold of a url: its host, the parent domains and its address, that is host and path."""
    return F.array_append(suffixes(host), F.concat(host, path))


def verdicts(pages: DataFrame, rules: list[Rule], blocked: DataFrame, id_col: str = "page_id", url_col: str = "url",
             most_bits: int = MOST_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    The longest rule that fits a url decides; else the cascade blocks urls whose host is, or lies under, a domain in
    ``blocked`` (column ``key``), or whose address is in it, and allows all others. Urls that are NULL or have no
    ``://`` have empty host and path, which no rule fits and no list holds, so they are allowed. Rows may repeat; no rows
    give no rows. Built-in expressions only; the list may be of any size.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    places = judged.filter(F.col("host") != "").select("host", "path")
    universe = places.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).union(
        places.select(F.concat("host", "path").alias("key")))
    found = judged.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("bad", F.lit(False))
    keys = keys_of(F.col("host"), F.col("path"))
    filters = cascades(universe, blocked, most_bits)
    for s, levels in enumerate(filters):
        if levels:
            mine = F.exists(keys, lambda key: (shard_of(key, len(filters)) == s) & listed_in(key, levels))  # noqa: B023
            found = found.withColumn("bad", F.col("bad") | ((F.col("host") != "") & mine))
            if len(filters) > 1:
                found = written(found, "url-verdicts")
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                        F.coalesce(F.col("hit.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
