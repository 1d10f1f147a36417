"""URL filters: rules and listed addresses in a sorted array of 64-bit digests.

``DigestList`` holds strings as sorted xxhash keys beside the strings themselves. The files go to the shared folder and
from there to every executor, where workers memory-map them. A probe is one vectorised binary search for all candidates
of a batch; each hit is confirmed against the stored string, so a digest collision never gives a wrong answer.

A rule is (host, path prefix, verdict) and fits the host and all its subdomains if the url's path starts with the
prefix. Candidates of a url are its host suffixes times the path lengths that occur among the rules; the longest
rule wins. Urls without a rule get the verdict of the listed addresses (host and path in full), else ``default``.
"""

from __future__ import annotations

import functools
import io
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import put_file, ready, table

#: fixed values: the rules of the registered query
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_ENTRIES = 20_000_000
RESULT = "struct<rule:string,verdict:string>"


class DigestList:
    """Strings with a small integer each, found by digest."""

    def __init__(self, keys, starts, blob, tags):
        self.keys, self.starts, self.blob, self.tags = keys, starts, blob, tags

    @staticmethod
    def files(entries: dict[str, int], digest=xxhash.xxh64_intdigest) -> dict[str, bytes]:
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"{len(entries)} entries; a list holds at most {MAX_ENTRIES}")
        rows = sorted((digest(s.encode()), s.encode(), tag) for s, tag in entries.items())
        arrays = {
            "keys": np.array([r[0] for r in rows], np.uint64),
            "starts": np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
            "blob": np.frombuffer(b"".join(r[1] for r in rows), np.uint8),
            "tags": np.array([r[2] for r in rows], np.int32),
        }
        out = {}
        for name, array in arrays.items():
            np.save(file := io.BytesIO(), array)
            out[name] = file.getvalue()
        return out

    @classmethod
    def opened(cls, paths: dict[str, str]) -> DigestList:
        """Memory-maps the files; an empty array can't be mapped and is read."""

        def load(path: str) -> np.ndarray:
            try:
                return np.load(path, mmap_mode="r")
            except ValueError:
                return np.load(path)

        return cls(*(load(paths[n]) for n in ("keys", "starts", "blob", "tags")))

    def probe(self, strings: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The tag of each string, -1 where it isn't listed."""
        wanted = np.fromiter((digest(s) for s in strings), np.uint64, len(strings))
        out = np.full(len(strings), -1, np.int64)
        at = np.searchsorted(self.keys, wanted)
        open_ = np.flatnonzero(at < len(self.keys))
        open_ = open_[self.keys[at[open_]] == wanted[open_]]
        for i in open_:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                if self.blob[self.starts[k] : self.starts[k + 1]].tobytes() == strings[i]:
                    out[i] = self.tags[k]
                    break
                k += 1
        return out


def share(spark: SparkSession, files: dict[str, bytes]) -> dict[str, str]:
    """Writes files to the shared folder and names them to all executors; returns their local names."""
    names = {kind: f"{kind}-{uuid.uuid4().hex}.npy" for kind in files}
    for kind, content in files.items():
        spark.sparkContext.addFile(put_file(spark, names[kind], content))
    return names


@functools.lru_cache(maxsize=4)
def _opened(names: str) -> DigestList:
    return DigestList.opened({k: SparkFiles.get(v) for k, v in json.loads(names).items()})


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for a null or a url without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: bytes) -> list[bytes]:
    parts = host.split(b".")
    return [b".".join(parts[i:]) for i in range(len(parts))]


def judge(
    spark: SparkSession,
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    listed: Iterable[str] = (),
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``listed`` are blocked addresses (host and path). A null url, or one without ``://``, has an empty host and path,
    fits no rule and gets ``default``. Repeated rows give repeated results, an empty table none; other columns
    of ``pages`` are ignored.
    """
    ready(spark)
    rules = list(rules)
    if len({(h, p) for h, p, _ in rules}) < len(rules):
        raise ValueError("two rules have the same host and path")
    entries = {f"{host}\n{path}": i for i, (host, path, _) in enumerate(rules)}
    names = json.dumps(share(spark, DigestList.files(entries)))
    blocked = json.dumps(share(spark, DigestList.files({s: 0 for s in listed})))
    lengths = sorted({len(path.encode()) for _, path, _ in rules})
    shown = [f"{host}{path}" for host, path, _ in rules]
    verdicts = [v for _, _, v in rules]

    @F.arrow_udf(RESULT)
    def verdict(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        by_rule, by_list = _opened(names), _opened(blocked)
        for hosts, paths in parts:
            candidates, owner, whole = [], [], []
            for i, (host, path) in enumerate(zip(hosts.to_pylist(), paths.to_pylist())):
                h, p = host.encode(), path.encode()
                whole.append(h + p)
                if h:
                    mine = [s + b"\n" + p[:n] for s in suffixes(h) for n in lengths if n <= len(p)]
                    candidates += mine
                    owner += [i] * len(mine)
            hits = by_rule.probe(candidates)
            best: dict[int, int] = {}
            for k in np.flatnonzero(hits >= 0):
                i, r = owner[k], int(hits[k])
                if i not in best or len(shown[r]) > len(shown[best[i]]):
                    best[i] = r
            on_list = by_list.probe(whole) >= 0
            yield pa.array(
                [
                    {"rule": shown[best[i]], "verdict": verdicts[best[i]]}
                    if i in best
                    else {"rule": None, "verdict": "block" if on_list[i] else default}
                    for i in range(len(whole))
                ],
                pa.struct([("rule", pa.string()), ("verdict", pa.string())]),
            )

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.withColumn("_v", verdict.asNondeterministic()("host", "path")).select(
        "page_id", "host", "path", "_v.rule", "_v.verdict"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path))
          FROM rules WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS r
  FROM parts p
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM judged
"""
