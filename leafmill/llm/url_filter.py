"""URL filters on a sorted digest array (operator 3).

Rules are (host, path, verdict).  Their strings, host and path written
together, are kept in full; the sorted array of their 64-bit xxhash digests is
memory-mapped by the workers.  A URL's candidates are its host and all
superdomains, each with those prefixes of its path whose lengths occur among
the rules.  Digests of a whole batch are looked up by one vectorised binary
search, and a hit counts only if the stored string is the candidate itself.
Of the rules that fit the longest wins.

Cases: a null URL, or one without ``://``, has an empty host and path and no
rule; without a rule the verdict is the default, allow; equal rules must agree
or the later one counts; very long URLs are judged whole; an empty table gives
an empty one; rows without page_id keep their null; repeated rows are each
judged; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame

from leafmill.llm.scratch import Scratch, local_path, only

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [len(rest)] + [i for i in map(rest.find, "/?#") if i >= 0]
    host, rest = rest[: min(ends)], rest[min(ends) :]
    return host.translate(_ASCII), rest[: min([len(rest)] + [i for i in map(rest.find, "?#") if i >= 0])]


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Files of one rule list: sorted digests, and by the same order verdicts and full strings."""

    def __init__(self, root: str, lengths: tuple[int, ...]):
        self.root, self.lengths = root, lengths
        self._open: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    @classmethod
    def build(cls, rules: Iterable[Rule], root: str, hash_of=digest) -> DigestArray:
        kept = {host.translate(_ASCII) + path: (path, verdict) for host, path, verdict in rules}
        order = sorted(kept, key=lambda k: (hash_of(k), k))
        blobs = [k.encode() for k in order]
        _store(f"{root}/digests.npy", np.array([hash_of(k) for k in order], np.uint64))
        _store(f"{root}/bounds.npy", np.cumsum([0, *map(len, blobs)]).astype(np.int64))
        _store(f"{root}/verdicts.npy", np.array([kept[k][1] == "block" for k in order], bool))
        _store(f"{root}/strings.npy", np.frombuffer(b"".join(blobs), np.uint8))
        return cls(root, tuple(sorted({len(p) for p, _ in kept.values()})))

    def _files(self) -> tuple:
        if self._open is None:
            self._open = tuple(_load(f"{self.root}/{n}.npy") for n in ("digests", "bounds", "verdicts", "strings"))
        return self._open

    def find(self, keys: list[str], hash_of=digest) -> np.ndarray:
        """For each key its place in the array, or -1."""
        digests, bounds, _, strings = self._files()
        asked = np.array([hash_of(k) for k in keys], np.uint64)
        at, out = np.searchsorted(digests, asked), np.full(len(keys), -1)
        for i in np.flatnonzero((at < len(digests)) & (digests[np.minimum(at, len(digests) - 1)] == asked) if len(digests) else []).tolist():
            place, key = int(at[i]), keys[i].encode("utf-8", "surrogatepass")
            while place < len(digests) and digests[place] == asked[i]:
                if strings[bounds[place] : bounds[place + 1]].tobytes() == key:
                    out[i] = place
                    break
                place += 1
        return out

    def judge(self, urls: list[str | None], default: str = "allow", hash_of=digest) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL."""
        split = [parts(u) for u in urls]
        keys: list[str] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(split):
            labels = host.split(".") if host else []
            for n in self.lengths:
                if len(path) >= n:
                    for k in range(len(labels)):
                        keys.append(".".join(labels[k:]) + path[:n])
                        owner.append(i)
        best: dict[int, tuple[int, str, int]] = {}
        for i, key, place in zip(owner, keys, self.find(keys, hash_of).tolist(), strict=True):
            if place >= 0 and (i not in best or len(key) > best[i][0]):
                best[i] = len(key), key, place
        verdicts = self._files()[2]
        return [(h, p, best[i][1], "block" if verdicts[best[i][2]] else "allow") if i in best else (h, p, None, default) for i, (h, p) in enumerate(split)]


def _store(uri: str, array: np.ndarray) -> None:
    data = io.BytesIO()
    np.save(data, array)
    if path := local_path(uri):
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as to:
            to.write(data.getvalue())
    else:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        with fs.open_output_stream(path) as to:
            to.write(data.getvalue())


def _load(uri: str) -> np.ndarray:
    if path := local_path(uri):
        from numpy.lib.format import open_memmap

        with open(path, "rb") as f:  # an empty array can't be mapped
            head = np.load(f, mmap_mode=None) if _empty(path) else None
        return head if head is not None else open_memmap(path, mode="r")
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


def _empty(path: str) -> bool:
    import os

    return os.path.getsize(path) <= 128


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow", scratch: Scratch | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    index = DigestArray.build(rules, f"{scratch.root}/index")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = index.judge(batch["url"].to_pylist(), default)
            yield pa.RecordBatch.from_arrays([batch["page_id"], *[pa.array([f[i] for f in found], pa.string()) for i in range(4)]], ["page_id", "host", "path", "rule", "verdict"])

    return only(pages, "page_id", "url").mapInArrow(work, "page_id bigint, host string, path string, rule string, verdict string")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = {
    "op3_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM h),
        r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, v,
                     row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC) AS k
              FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
    """
}
QUERIES = {"op3_url_filter": op3_url_filter}
