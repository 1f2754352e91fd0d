"""Allow and block lists for URLs, matched in a broadcast trie.

The trie runs over the reversed labels of the host; each host node holds a
second trie over path segments.  A rule fits its host and all subdomains if
the URL's path starts with the rule's path.  Of the fitting rules the one
with the most host labels wins, then the one with the longest path; an
allow and a block entry for the same place: block.

Defined results: a very long URL is matched whole, one look-up a segment
and length of rule; a null URL or one without ``://`` has an empty host and
path and fits no rule; repeated rows are judged one by one; an empty table
gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000       # the trie is broadcast; longer lists are refused
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_FOLD = {c: c + 32 for c in range(65, 91)}


class HostNode:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class PathNode:
    """Rules that end here: ``partial`` maps the start of the next segment to (rule, verdict).

    ``sizes`` has the lengths of those starts, longest first, so that a
    segment is looked up once a length and not once a rule.
    """
    __slots__ = ("segments", "partial", "sizes")

    def __init__(self):
        self.segments: dict[str, PathNode] = {}
        self.partial: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []


def build_trie(rules: Iterable[tuple[str, str, str]]) -> HostNode:
    """Trie of (verdict, host, path) rules; verdict is ``allow`` or ``block``."""
    root = HostNode()
    for n, (verdict, host, path) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.translate(_FOLD).split(".")):
            node = node.labels.setdefault(label, HostNode())
        node.paths = at = node.paths or PathNode()
        *whole, rest = path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, PathNode())
        if len(rest) not in at.sizes:
            at.sizes = sorted([*at.sizes, len(rest)], reverse=True)
        if verdict == "block" or rest not in at.partial:
            at.partial[rest] = (host + path, verdict)
    return root


def split_url(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


def _longest_path(at: PathNode, path: str) -> tuple[str, str] | None:
    best, segments = None, path.split("/")
    for k, segment in enumerate(segments):
        for size in at.sizes:
            if size <= len(segment) and (found := at.partial.get(segment[:size])):
                best = found
                break
        if k + 1 == len(segments) or segment not in at.segments:
            break
        at = at.segments[segment]
    return best


def match(root: HostNode, host: str, path: str) -> tuple[str, str] | None:
    """The winning (rule, verdict), or None."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.paths is not None:
            best = _longest_path(node.paths, path) or best
    return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``; without a fitting rule ``default`` holds."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [match(root, *p) or (None, default) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.string()) for x in
                                ([p[0] for p in parts], [p[1] for p in parts],
                                 [f[0] for f in found], [f[1] for f in found]))],
                ["id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(judge, "id bigint, host string, path string, rule string, verdict string")


def allowed_pages(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url",
                  default: str = "allow") -> DataFrame:
    """``pages`` whose URL is allowed, all columns kept."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("boolean")
    def allowed(url):
        return url.map(lambda u: (match(trie.value, *split_url(u)) or (None, default))[1] == "allow").astype(bool)

    return pages.filter(allowed(F.col(url_col).cast("string")))
