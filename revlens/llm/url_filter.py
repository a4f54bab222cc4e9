"""URL filters: allow and block entries in a trie, the longest match decides.

An entry is a host and a path (``example.org/es/``).  It fits its host and all subdomains
when the url's path starts with its own.  The trie goes down the host's labels from the
right, then the segments of the path; the last segment of an entry may be the beginning of
the url's.  Of all entries that fit, the one that goes deepest decides: more host labels
first, then the longer path.  An entry given as both allow and block blocks.

The trie is broadcast.  Entries beyond ``MOST_BYTES`` are dealt over several tries of at
most that size, which the urls pass one after the other with the best entry so far, so that
a worker never holds more than one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from revlens.llm.common import cut

MOST_BYTES = 16 << 20       # of the entries' text in one trie
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
Rule = tuple[str, str, str]          # verdict, host, path


def parse(entries: Iterable[str]) -> list[Rule]:
    """``"block example.org/es/"`` -> (block, example.org, /es/); A-Z of the host lower-cased."""
    rules = []
    for entry in entries:
        verdict, _, place = entry.strip().partition(" ")
        if verdict not in ("allow", "block"):
            raise ValueError(f"an entry starts with allow or block: {entry!r}")
        host, slash, path = place.strip().partition("/")
        rules.append((verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path))
    return rules


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class Node:
    __slots__ = ("labels", "segments", "starts")

    def __init__(self):
        self.labels: dict[str, Node] = {}       # next host label
        self.segments: dict[str, Node] = {}     # next whole path segment
        self.starts: dict[str, Rule] = {}       # beginnings of the next segment that end an entry


class Trie:
    """Entries over reversed host labels and path segments."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        verdict, host, path = rule
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.setdefault(label, Node())
        *whole, start = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if verdict == "block" or start not in node.starts:
            node.starts[start] = rule

    def longest(self, host: str, path: str) -> tuple[int, Rule] | None:
        """The deepest entry that fits, with its number of host labels."""
        node, depth, segments = self.root, 0, path.split("/")
        best = None
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node, depth = node.labels.get(label), depth + 1
                if node is None:
                    break
            found = self._along(node, segments)
            if found:
                best = (depth, found)
        return best

    @staticmethod
    def _along(node: Node | None, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            if node is None:
                break
            for n in sorted({len(s) for s in node.starts}, reverse=True):
                if n <= len(segment) and (rule := node.starts.get(segment[:n])):
                    best = rule
                    break
            node = node.segments.get(segment)
        return best


def _shards(rules: list[Rule], most_bytes: int) -> list[list[Rule]]:
    shards, size = [[]], 0
    for rule in rules:
        n = sum(len(x.encode()) for x in rule) + 64
        if shards[-1] and size + n > most_bytes:
            shards.append([])
            size = 0
        shards[-1].append(rule)
        size += n
    return shards


# columns that carry the best entry so far from one trie to the next
_CARRIED = [StructField("llm_depth", LongType()), StructField("llm_length", LongType()),
            StructField("rule", StringType()), StructField("verdict", StringType())]


def _judge(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    trie = rows.sparkSession.sparkContext.broadcast(rules)
    schema = StructType([f for f in rows.schema.fields if f.name not in {c.name for c in _CARRIED}] + _CARRIED)
    names = schema.names
    built: list[Trie] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Trie(trie.value))
        longest = built[0].longest
        for batch in batches:
            old = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            out = {c.name: [] for c in _CARRIED}
            for k, (host, path) in enumerate(zip(old["host"].to_pylist(), old["path"].to_pylist())):
                best = [old[c.name][k].as_py() for c in _CARRIED] if "rule" in old else [-1, -1, None, None]
                if found := longest(host, path):
                    depth, (verdict, own_host, own_path) = found
                    if (depth, len(own_path), verdict) > (best[0], best[1], best[3] or ""):
                        best = [depth, len(own_path), own_host + own_path, verdict]
                for c, v in zip(out, best):
                    out[c].append(v)
            new = {"llm_depth": pa.array(out["llm_depth"], pa.int64()), "llm_length": pa.array(out["llm_length"], pa.int64()),
                   "rule": pa.array(out["rule"], pa.string()), "verdict": pa.array(out["verdict"], pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, old.get(c)) for c in names], names=names)

    return rows.mapInArrow(work, schema)


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the entry that decides, null if none fits) and
    ``verdict`` (its verdict, else ``default``: what no entry names is allowed).

    A null url or one without ``://`` has an empty host and path; an empty host fits only
    entries without a host, which fit every host.  Repeated rows are judged alike, equal
    entries count once.  Input columns of the new names are replaced (also when one of them
    holds the urls), all others pass unchanged; all rows stay.
    """
    url = F.col(f"`{url_col}`").cast("string")
    rows = df.withColumns({"host": host_of(url), "path": path_of(url)}).drop("rule", "verdict", "llm_depth", "llm_length")
    shards = _shards(list(dict.fromkeys(rules)), most_bytes)
    for k, shard in enumerate(shards):
        rows = _judge(rows, shard)
        if k + 1 < len(shards):
            rows = cut(rows, "url-rules")
    keep = [c for c in rows.columns if c not in ("llm_depth", "llm_length", "rule", "verdict")]
    return rows.select(*(F.col(f"`{c}`") for c in keep), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def oracle(rules: list[Rule], table: str = "pages", default: str = "allow") -> str:
    """The same for DuckDB, with string positions and a comparison with every entry."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {listed}),
tails AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM {table}),
plain AS (SELECT page_id, split_part(split_part(t, '?', 1), '#', 1) AS t FROM tails),
parts AS (SELECT page_id, translate(split_part(t, '/', 1), '{UPPER}', '{LOWER}') AS host,
                 CASE WHEN strpos(t, '/') > 0 THEN substr(t, strpos(t, '/')) ELSE '' END AS path FROM plain),
fits AS (SELECT p.page_id, p.host, p.path, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC, r.verdict DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, '{default}') AS verdict FROM fits WHERE k = 1"""
