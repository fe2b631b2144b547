"""URL filters by a Bloom filter cascade, in DataFrame operations alone.

The keys of a url are the strings ``host suffix + path prefix`` that a rule
could have: each suffix of the host at a dot, with each prefix of the path that
is as long as some rule's path. The cascade's first filter encodes the listed
keys. The corpus's other keys that it lets through are found once and encoded
in a second filter; the listed keys which that one lets through in a third; and
so on until none is left. For every key of the corpus the first filter that
lacks it then tells, exactly, whether it is listed: an even filter says yes, an
odd one no. Judging a url reads the filters, a few words, and joins nothing.
Rules are dealt to blocks by a hash of their keys. Each block has its cascade
and is judged in its own pass, so that the filters of one pass are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import LOWER, UPPER, lower_ascii, materialize

#: Rules of one block: a block's filters, some tens of bits a rule, are handed to every task.
BLOCK_RULES = 4 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Both empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_sizes: list[int]) -> Column:
    """The keys of a url that a rule could have, longest first; of equally long ones that with the longer host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*(F.lit(n) for n in path_sizes)), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.reverse(F.array_sort(keys)), lambda k: k["key"])


class Level:
    """One filter: bits, hashes of a key, and its words once written. ``salt``: no two filters of a cascade hash alike."""

    def __init__(self, keys: DataFrame, n: int, false_rate: float, salt: int):
        self.salt = salt
        self.hashes = max(1, math.ceil(-math.log2(false_rate)))
        self.bits = max(64, math.ceil(n * self.hashes / math.log(2)) | 1)
        words = -(-self.bits // 64)
        key = F.col("key")
        at = F.explode(F.array(*(self._at(key, i) for i in range(self.hashes))))
        set_bits = keys.select(at.alias("at")).select(F.floor(F.col("at") / 64).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
        every = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        dense = set_bits.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
        row = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        self.table = materialize(row, "filter")

    def _at(self, key: Column, i: int) -> Column:
        step = F.pmod(F.xxhash64(key, F.lit(-1 - self.salt)), F.lit(self.bits)) if i else F.lit(0)
        return F.pmod(F.pmod(F.xxhash64(key, F.lit(self.salt)), F.lit(self.bits)) + step * F.lit(i), F.lit(self.bits))

    def holds(self, key: Column, words: Column) -> Column:
        out = F.lit(True)
        for i in range(self.hashes):
            at = self._at(key, i)
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1))
            out = out & (bit == 1)
        return out

    def words(self) -> Column:
        return self.table.scalar()


class Cascade:
    """Exact membership of ``listed`` for every key of ``universe`` (DataFrames with the column ``key``)."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        listed = materialize(listed.select("key").distinct(), "listed")
        n = listed.count()
        self.levels: list[Level] = []
        self.n_listed = n
        if not n:
            return
        others = universe.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(0.5, max(2.0**-40, 0.7 * n / max(1, others)))
        self._add(listed, n, rate)
        # of the corpus's keys only those that the first filter lets through are compared with the list
        through = universe.select("key").where(self._holds(0)).distinct()
        inside, outside = listed, materialize(through.join(listed, "key", "left_anti"), "let-through")
        while (n := outside.count()) > 0:
            self._add(outside, n, 0.5)
            inside, outside = outside, materialize(inside.where(self._holds(-1)), "let-through")

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        self.levels.append(Level(keys, n, rate, len(self.levels)))

    def _holds(self, k: int) -> Column:
        return self.levels[k].holds(F.col("key"), self.levels[k].words())

    @property
    def bits(self) -> int:
        return sum(level.bits for level in self.levels)

    def contains(self, key: Column, words: list[Column]) -> Column:
        """Whether the key is listed; words: of each level, as columns."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(~self.levels[k].holds(key, words[k]), F.lit(k % 2 == 1)).otherwise(out)
        return out


def parse_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as (action, ``host/path``) to the columns action, host (A-Z lower-cased, as those of urls), path."""
    low = str.maketrans(UPPER, LOWER)
    rows = [(action, *(lambda h, s, p: (h.translate(low), s + p))(*rule.partition("/"))) for action, rule in rules]
    return spark.createDataFrame(rows, "action string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """One row for each row of ``pages``: the id, host, path, rule, verdict.

    rules: action (block or allow), host, path; a rule with a null in one of
    them is none. A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest that fits wins, of equally long ones
    that with the longer host, and block before allow where both list the same
    key. Where none fits, no key of the url is in the cascade: rule is null and
    the verdict ``default``. Repeated rows each give a row; null urls have an
    empty host and path. Other columns are not read. An empty table gives no
    row. The keys of a url are as many as its host's labels times the different
    lengths of rule paths that it reaches.
    """
    host, path = host_path(F.col("u"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    listed = rules.select(F.concat("host", "path").alias("key"), "action", F.length("path").alias("size")).where("key is not null and action is not null")
    sizes = sorted(r[0] for r in listed.select("size").distinct().collect())
    if not sizes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = urls.select("page_id", "host", "path", F.lit(None).cast("struct<place:int,rule:string,block:boolean>").alias("best"))
    blocks = max(1, -(-listed.count() // block_rules))
    for b in range(blocks):
        judged = _judge_block(judged, listed, sizes, b, blocks)
        if b + 1 < blocks:
            judged = materialize(judged, "judged")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _judge_block(judged: DataFrame, listed: DataFrame, sizes: list[int], b: int, blocks: int) -> DataFrame:
    """``judged`` with the rules of block ``b``: of the known best and the block's first key that is listed, the earlier among the url's keys."""
    own = lambda k: F.pmod(F.xxhash64(k, F.lit(-7)), F.lit(blocks)) == b
    listed = listed.where(own(F.col("key")))
    keys = F.transform(candidate_keys(F.col("host"), F.col("path"), sizes), lambda k, i: F.struct(i.alias("place"), k.alias("key")))
    keyed = judged.withColumn("keys", F.filter(keys, lambda k: own(k["key"])) if blocks > 1 else keys)
    every = Cascade(keyed.select(F.explode("keys.key").alias("key")), listed)
    if not every.levels:
        return judged
    blocked = Cascade(listed, listed.where("action = 'block'"))
    # the filters' words stand beside each row: one constant for all
    with_words = keyed.withColumns({f"w{k}": level.words() for k, level in enumerate(every.levels)})
    words = [F.col(f"w{k}") for k in range(len(every.levels))]
    found = F.get(F.filter("keys", lambda k: every.contains(k["key"], words)), F.lit(0))
    hit = with_words.select("page_id", "host", "path", "best", found.alias("found"))
    block = blocked.contains(F.col("found.key"), [level.words() for level in blocked.levels])
    new = F.when(F.col("found").isNotNull(), F.struct(F.col("found.place").cast("int").alias("place"), F.col("found.key").alias("rule"), block.alias("block")))
    earlier = F.col("best").isNull() | (F.col("found.place") < F.col("best.place"))
    return hit.select("page_id", "host", "path", F.when(F.col("found").isNotNull() & earlier, new).otherwise(F.col("best")).alias("best"))
