"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.common import ascii_lower, col

#: A rule: verdict, host, path.
Rule = tuple[str, str, str]
PAGES_PER_TASK = 50_000
SAMPLE = 20_000
#: Characters of a key and of a path that decide between parts.
HEAD = 256
#: Rows of placed rules handed over at a time.
PLACES = 10_000
FIELDS = ["part", "key", "kind", "page_id", "host", "path", "verdict"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
    from there up to ``?``, ``#`` or the end.  Both are empty for null and where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return ascii_lower(host), F.substring(rest, F.length(host) + F.lit(1), F.length(rest))


def host_key(host: str) -> str:
    """The labels of a host reversed, each closed by the least character: ``b.a`` gives ``a0 b0``.

    A host and all its subdomains then share a prefix and are neighbours in the
    order of keys.  The two least characters are escaped inside a label."""
    host = host.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01")
    return "".join(label + "\x00" for label in reversed(host.split("."))) if host else ""


def _key(host: Column) -> Column:
    """:func:`host_key` of a column."""
    plain = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\x00"), F.lit("\x00")))


def after(prefix: bytes) -> bytes:
    """The least bytes above everything that starts with ``prefix``."""
    return prefix[:-1] + bytes([prefix[-1] + 1]) if prefix else b"\xff"


class Active:
    """The rules of one host, given in ascending order of their paths, while its interval of keys is open."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.outer: list[int] = []  # the longest rule that is a proper prefix of this one, or -1

    def add(self, path: str, verdict: str) -> None:
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.outer.append(at)
        self.paths.append(path)
        self.verdicts.append(verdict)

    def longest(self, path: str) -> int:
        """Number of the longest rule that ``path`` starts with, or -1.

        Every such rule is a prefix of the last rule not above ``path``, too:
        only that one and those around it need a look."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


class Sweep:
    """Merges rules and pages that come in ascending order of ``(key, rules first, path)``.

    The stack holds the hosts with rules whose interval of keys is open; as
    the intervals are prefixes, each lies inside the one below it."""

    def __init__(self) -> None:
        self.stack: list[Active] = []
        self.last: tuple = (None, None)
        self.found: tuple[str, str] | None = None

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Active(key, host))
        self.stack[-1].add(path, verdict)
        self.last = (None, None)

    def page(self, key: str, path: str) -> tuple[str, str] | None:
        """``(rule, verdict)`` of the longest rule that fits."""
        if (key, path) != self.last:
            self.close(key)
            size, self.last, self.found = -1, (key, path), None
            for host in reversed(self.stack):
                at = host.longest(path)
                if at >= 0 and len(host.host) + len(host.paths[at]) > size:
                    size = len(host.host) + len(host.paths[at])
                    self.found = (host.host + host.paths[at], host.verdicts[at])
        return self.found


Bound = tuple[bytes, bytes, int]


def parts_of(key: str, path: str, bounds: list[Bound]) -> Iterator[int]:
    """The parts that can hold pages the rule fits: those its interval of keys meets.  Where a part lies
    within one host, its pages are an interval of paths as well, which the rule's must meet."""
    start, head = key[:HEAD].encode(), path[:HEAD].encode()
    at, stop = bisect_left(bounds, (start,)), bisect_left(bounds, (after(start),))
    while at <= stop:
        if 0 < at < len(bounds) and bounds[at - 1][0] == bounds[at][0]:
            host = bounds[at][0]
            end = bisect_left(bounds, (host + b"\x00",)) - 1  # the last part within this host
            first, last = bisect_left(bounds, (host, head)), bisect_left(bounds, (host, after(head)))
            yield from range(max(at, first), min(end, stop, last) + 1)
            at = end + 1
        else:
            yield at
            at += 1


def _rules(spark: SparkSession, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """``(verdict, host, path)`` without repeats; refuses nulls and rules that contradict each other."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = rules.select(*[F.col(c).cast("string").alias(c) for c in ("verdict", "host", "path")])
    each = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("other"), F.count("*").alias("n"), F.count("verdict").alias("given"))
    wrong = each.where("host is null or path is null or n > given or verdict <> other").select("host", "path").first()
    if wrong:
        raise ValueError(f"rules for {wrong['host']}{wrong['path']} hold a null or contradict each other")
    return each.select("verdict", "host", "path")


def _bounds(heads: DataFrame, total: int, tasks: int) -> list[Bound]:
    """Cuts of ``(key, path, salt)`` into ``tasks`` parts of about as many rows, from about ``SAMPLE`` rows chosen by a hash of
    their salt.  Equal rows are counted on Spark, so no repetition makes what reaches the driver longer."""
    if tasks == 1:
        return []
    chosen = heads.where(F.pmod(F.xxhash64("salt", F.lit(6)), F.lit(total)) < SAMPLE).groupBy("key", "path", "salt").count()
    rows = sorted((r["key"].encode(), r["path"].encode(), r["salt"], r["count"]) for r in chosen.collect())
    ends = list(itertools.accumulate(r[3] for r in rows))
    return [rows[bisect_right(ends, ends[-1] * i // tasks)][:3] for i in range(1, tasks)] if rows else []


def judge(pages: DataFrame, rules: DataFrame | Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` is a list of ``(verdict, host, path)`` or a table of any size with
    these columns.  A rule fits its host and all subdomains if the path starts
    with the rule's; the longest (host and path together) wins, and of equally
    long ones that of the longer host.  Pages without a fitting rule, with a
    null url or without ``://`` have a null rule and the ``default`` verdict.
    Two rules for the same host and path must agree; a null in a rule is
    refused.  Repeated rows come back as often as given; other columns (page
    bodies) are not read.

    Pages and rules are the two sides of a sort-merge join.  Both are cut into
    parts by the same bounds on the reversed-host key, the path and a hash of
    the page, so a host or url with any share of the pages spreads over as many
    tasks as it fills; the bounds come from about ``SAMPLE`` pages chosen
    by another hash.  A rule goes to the parts its interval meets: to the one it
    starts in and to those at whose lower bound it is open.  Each task merges
    its sorted rows and holds the rules of the hosts open at the moment.
    """
    spark = pages.sparkSession
    table = _rules(spark, rules)
    host, path = url_parts(col(url_col).cast("string"))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", _key(F.col("host")).alias("key"), F.xxhash64("page_id", "host", "path").alias("salt"))
    heads = rows.select(F.substring("key", 1, HEAD).alias("key"), F.substring("path", 1, HEAD).alias("path"), "salt")
    total = rows.count()
    tasks = max(1, -(-total // PAGES_PER_TASK), min(spark.sparkContext.defaultParallelism, total // 1000))
    bounds = _bounds(heads, total, tasks)

    def place_pages(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, paths, salts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "path", "salt"))
            part = [bisect_right(bounds, (k[:HEAD].encode(), p[:HEAD].encode(), s)) for k, p, s in zip(keys, paths, salts)]
            kept = batch.select(["page_id", "host", "path", "key"]).columns
            empty = pa.nulls(len(part), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), kept[3], pa.array([1] * len(part), pa.int32()), kept[0], kept[1], kept[2], empty], FIELDS)

    def place_rules(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            out = []
            for verdict, host, path in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("verdict", "host", "path"))):
                key = host_key(host)
                for part in parts_of(key, path, bounds):
                    out.append((part, key, 0, None, host, path, verdict))
                    if len(out) == PLACES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], FIELDS)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], FIELDS)

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, sweep = None, Sweep()
        for batch in batches:
            out = []
            for part, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    now, sweep = part, Sweep()
                if kind == 0:
                    sweep.rule(key, host, path, verdict)
                else:
                    out.append((page, host, path, *(sweep.page(key, path) or (None, default))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "host", "path", "rule", "verdict"])

    shape = "part int, key string, kind int, page_id long, host string, path string, verdict string"
    both = rows.mapInArrow(place_pages, shape).union(table.mapInArrow(place_rules, shape))
    dealt = both.repartitionById(tasks, "part").sortWithinPartitions("part", "key", "kind", "path")
    return dealt.mapInArrow(merge, "page_id long, host string, path string, rule string, verdict string")
