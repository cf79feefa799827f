"""URL filter: a trie over reversed host labels, then path segments, with longest match.

Rules are few and given by the caller; the compiled trie is checked against
``MAX_RULES`` before it is sent to the executors.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import schema

#: The rules of the registered query (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Bound of the broadcast trie, in rules.
MAX_RULES = 1_000_000

_AFTER_HOST = re.compile(r"[/?#]")
_AFTER_PATH = re.compile(r"[?#]")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def build_trie(rules) -> dict:
    """Host labels are edges from the top-level domain down; a host node may own a path trie.

    A path rule ends in a partial segment (possibly empty), so ``/en/1`` fits
    ``/en/1``, ``/en/12`` and ``/en/1/x``, and ``/es/`` fits only below it.
    Of two entries for the same host and path, block wins.
    """
    rules = tuple(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES}")
    root: dict = {"hosts": {}}
    for verdict, host, path in rules:
        if not path.startswith("/"):
            raise ValueError(f"a rule's path starts with '/': {path!r}")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node["hosts"].setdefault(label, {"hosts": {}})
        *inner, last = path.split("/")[1:]
        place = node.setdefault("path", {"next": {}, "ends": {}, "lengths": []})
        for seg in inner:
            place = place["next"].setdefault(seg, {"next": {}, "ends": {}, "lengths": []})
        if last not in place["ends"] or verdict == "block":
            place["ends"][last] = (verdict, host + path)
        at = bisect_left(place["lengths"], len(last))
        if place["lengths"][at:at + 1] != [len(last)]:
            place["lengths"].insert(at, len(last))
    return root


def _longest_end(place: dict, seg: str):
    """The entry of the longest partial segment that begins this one: one lookup per length that ends here."""
    lengths, ends = place["lengths"], place["ends"]
    for n in reversed(lengths[:bisect_right(lengths, len(seg))]):
        hit = ends.get(seg[:n])
        if hit:
            return hit
    return None


def longest_match(root: dict, host: str, path: str):
    """(verdict, rule) of the longest fitting rule, host and path together (ties: the deeper host); or None."""
    best, node = None, root
    segments = path.split("/")[1:] if path.startswith("/") else []
    for label in reversed(host.split(".")):
        node = node["hosts"].get(label)
        if node is None:
            break
        place = node.get("path")
        for seg in segments:
            if place is None:
                break
            deepest = _longest_end(place, seg)
            if deepest:
                best = deepest if best is None or len(deepest[1]) >= len(best[1]) else best
            place = place["next"].get(seg)
    return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if not url:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    m = _AFTER_HOST.search(rest)
    host, rest = (rest, "") if m is None else (rest[:m.start()], rest[m.start():])
    if not rest.startswith("/"):
        return host.translate(_LOWER), ""
    m = _AFTER_PATH.search(rest)
    return host.translate(_LOWER), rest if m is None else rest[:m.start()]


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A url that no rule fits gets ``default`` and a null rule. Null or
    malformed urls have empty host and path and so the default; a null id is
    kept; repeated rows are each judged; an empty table gives no rows. Only
    the two named columns are read, so other columns cannot clash.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for b in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                hit = longest_match(root, host, path)
                hosts.append(host)
                paths.append(path)
                verdicts.append(hit[0] if hit else default)
                found.append(hit[1] if hit else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"))
    return rows.mapInArrow(run, schema("page_id bigint, host string, path string, rule string, verdict string"))


URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), one AS (
  SELECT DISTINCT host, path FROM parts
), best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(verdict, length(rhost || rpath)) AS verdict
  FROM one JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""
