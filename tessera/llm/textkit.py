"""Shared pieces of the text operators.

Words of the byte kernels are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` gives; lower-casing touches A-Z alone, as ``bytes.lower()`` does.  Kernels get
whole texts: an Arrow batch is cut between documents, never inside one.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once (one longer text makes a piece of its own).
PIECE_BYTES = 1 << 19
_DEFAULT_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset and one process does all (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that all executors share")
    if "dir" not in _DEFAULT_DIR:
        _DEFAULT_DIR["dir"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _DEFAULT_DIR["dir"], True)
    return _DEFAULT_DIR["dir"]


def tidy() -> None:
    """Gives freed memory of this process back to the system: arrays that a model was trained on, Arrow's pool."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def stored(df: DataFrame, small: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors.

    A ``small`` table (edges, keys; a few bytes a text) is written by an eighth of the session's shuffle partitions, 32 at least.

    The shuffle files that led to it are of no more use; collecting the driver's garbage lets Spark
    remove them now instead of whenever the driver's heap fills up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    schema = df.schema
    if small:
        df = df.coalesce(max(32, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    tidy()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to be none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def kept_out(held: int, modulus: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, mod ``modulus``, equals ``held``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == held, F.lit(False))


def first_hashed(rows: DataFrame, most: int) -> DataFrame:
    """The at most ``most`` rows whose hashed doc_id comes first.  Rows far behind are sorted out by their hash, so tasks send few."""
    n = rows.count()
    share = min(1.0, (1.2 * most + 200) / max(1, n))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007))
    return rows.where(place < int(share * 1_000_000_007)).orderBy(place, "doc_id").limit(most)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64, col.offset + len(col) + 1)[col.offset :]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables of about ``rows`` rows, no key in two of them: a task holds that many rows and one key's."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield whole.slice(0, last)
            held = whole.slice(last).combine_chunks().to_batches()
            n -= last
    if held:
        yield pa.Table.from_batches(held)


def map_texts(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``kernel`` over pieces of whole rows."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                out = kernel(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the n + 1 offsets of its rows (null: empty)."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    ends = np.frombuffer(col.buffers()[1], np.int64, col.offset + len(col) + 1)[col.offset :]
    data = col.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def byte_lists(col: pa.Array) -> list[bytes]:
    return [v or b"" for v in col.cast(pa.binary()).to_pylist()]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, n), _powers(_BASE_INV, n)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words_of(data: np.ndarray, ends: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each row's words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial read off prefix sums, then mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position on; the last k - 1 positions run over the end and are cut."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)
