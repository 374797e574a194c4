"""What the operators share: tables in the cluster's shared folder, and text helpers.

Intermediate tables are written to the folder that ``spark.checkpoint.dir`` names, which every
executor can read again after any other executor is lost.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where the session names none, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="holdfast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's setting under which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/holdfast/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(column, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: ASCII marks that may end a word and then form one piece of their own.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items that ``codes`` name, laid end to end, and where each of them begins and the last one ends."""
    own = sizes[codes]
    edges = np.concatenate([[0], np.cumsum(own)])
    return ids[np.repeat(starts[codes] - edges[:-1], own) + np.arange(int(edges[-1]))], edges


class UnitEncoder:
    """Whole-text encoding by the tokenizers library with a bounded cache of words.

    The byte-level pre-tokenizer always starts a new piece at a single space or line feed that
    stands between two other characters, so the ids of a text are the ids of its units laid end to
    end.  A text with other white space, or with two such characters in a row, goes to the library
    whole.  A unit of Latin letters and then ASCII marks is two pieces: its word goes to the
    library's model as the one piece it is, and is kept; its marks, and every other unit, go through
    the whole tokenizer.  New ones go there together; the id of the line feed marks where each ends.
    Arrow kernels cut the texts and number the distinct units, which are looked up once a call.
    """

    def __init__(self, path: str, most: int = 250_000, chunk: int = 4 << 20) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.chunk = most, chunk
        #: Ids of words, led by their space or line feed, and of other units; and those of the turn before.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.feed = self._ids("\n")
        self.plain = len(self.feed) == 4 and "ByteLevel" in str(self.tokenizer.pre_tokenizer)[:40]
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = pre_tokenizers.Split(_LETTERS[10], "isolated")
        probe = [" word", " Stra\u00dfe", " a\u00f1o", "a", "WORDS", " dhe"]
        self.direct = self.plain and self.tokenizer.normalizer is None and self._pieces(probe) == [self._ids(w) for w in probe]

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, ids: list[int], n: int, skip: int) -> list[bytes] | None:
        """The ids of ``n`` items, each led by the line feed's id; None if these are not ``n``."""
        a = np.asarray(ids, dtype="<u4")
        at = np.flatnonzero(a == np.frombuffer(self.feed, dtype="<u4")[0])
        if len(at) != n:
            return None
        raw = a.tobytes()
        return [raw[i:j] for i, j in zip(((at + skip) * 4).tolist(), [*(at[1:] * 4).tolist(), len(raw)], strict=True)]

    def _pieces(self, words: list[str]) -> list[bytes] | None:
        """The ids of words that are one piece each."""
        text = ("\n" + "\n".join(words)).encode().decode("latin-1").translate(_LETTERS)
        return self._cut(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, len(words), 1)

    def _learn_words(self, cores: list[str]) -> None:
        """Keep the ids of units without their marks; no ids where such a unit is not a Latin word."""
        led, lines = [], []
        for core in cores:
            bare = core[1:] if core[:1] == "\n" else core
            if self.direct and bare.isalpha() and (bare.isascii() or max(bare) < "\u0250"):
                (led if bare is core else lines).append(core)
            else:
                self.words[core] = b""
        if led or lines:
            ids = self._pieces([" " + w for w in led] + [w[1:] for w in lines])
            self.words.update(zip(led, ids, strict=False))
            self.words.update((w, self.feed + i) for w, i in zip(lines, ids[len(led) :], strict=True))

    def _learn_odd(self, units: list[str]) -> None:
        """Keep the ids of whole units, and of marks alone (under a leading tab, which no unit has)."""
        inner = [u for u in units if "<" not in u and len(u.split()) == 1]
        led = [u for u in inner if u == u.strip()]
        lines = [u for u in inner if u[0] == "\n" and u[1:] == u.strip()]
        for own, text, skip in ((led, "\n" + "\n".join([" " + u for u in led]), 1), (lines, "".join(lines), 0)):
            if own:
                found = self._cut(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, len(own), skip)
                if found:
                    self.odd.update(zip(own, found, strict=True))
        for u in units:
            if u not in self.odd:
                self.odd[u] = self._ids(u[1:] if u[0] == "\t" else u if u[0] == "\n" else " " + u) if u else self._ids(" ")

    def _units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units laid end to end, and where each of them begins and the last one ends."""
        if len(self.words) > self.most:  # words not met since the last turn go
            self.words, self.older = {}, self.words
        if len(self.odd) > self.most // 4:
            self.odd = {}
        trimmed = pc.ascii_rtrim(distinct, _MARKS)
        coded = trimmed.dictionary_encode()
        cores, core_of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.words.get, cores))
        if None in found:
            new = list(compress(cores, map(_missing, found)))
            if self.older:
                known = [w for w in new if w in self.older]
                self.words.update((w, self.older[w]) for w in known)
                new = [w for w in new if w not in self.words] if known else new
            if new:
                self._learn_words(new)
            found = [self.words[w] if i is None else i for w, i in zip(cores, found, strict=True)]
        word = np.fromiter(map(bool, found), dtype=bool, count=len(found))[core_of]
        marked = pc.binary_length(distinct).to_numpy() > pc.binary_length(trimmed).to_numpy()
        second = np.full(len(distinct), len(found), dtype=np.int64)
        first = core_of.astype(np.int64)
        table, place = [*found, b""], {}
        get = self.odd.get
        at = np.flatnonzero(~word | marked)
        units = distinct.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        names = ["\t" + u[len(cores[c]) :] if w else u for u, c, w in zip(units, core_of[at].tolist(), word[at].tolist(), strict=True)]
        if new := [u for u in set(names) if u not in self.odd]:
            self._learn_odd(new)
        for i, u, w in zip(at.tolist(), names, word[at].tolist(), strict=True):
            k = place.get(u)
            if k is None:
                k = place[u] = len(table)
                table.append(get(u))
            if w:
                second[i] = k
            else:
                first[i] = k
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        ids, edges = _gather(np.frombuffer(b"".join(table), dtype="<u4"), np.cumsum(sizes) - sizes, sizes, np.stack([first, second], axis=1).ravel())
        return ids, edges[::2]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, each as little-endian unsigned 32-bit integers."""
        if not self.plain:
            return [self._ids(t) if t else b"" for t in texts]
        out, part, held = [], [], 0
        gc.disable()  # long lists without cycles; collections only walk them
        try:
            for t in texts:
                part.append(t)
                held += len(t) if t else 0
                if held >= self.chunk:
                    out += self._encode(part)
                    part, held = [], 0
            return out + self._encode(part)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [bool(t) and not _double_space(t) for t in texts]
        lists = pc.split_pattern(pc.replace_substring(pa.array(list(compress(texts, cut)), pa.large_string()), "\n", " \n"), " ")
        coded = lists.values.dictionary_encode()
        out = [self._ids(t) if t and not c else b"" for t, c in zip(texts, cut, strict=True)]
        if not len(coded):
            return out
        offsets = lists.offsets.to_numpy()
        codes = coded.indices.to_numpy()
        heads = lists.values.take(pa.array(offsets[:-1])).to_pylist()
        ids, begins = self._units(coded.dictionary)
        sizes = np.diff(begins)
        body = np.ones(len(codes), dtype=bool)
        body[offsets[:-1]] = False  # the first unit of a text has no space before it
        flat, edges = _gather(ids, begins[:-1], sizes, codes[body])
        raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
        inner = (edges[offsets - np.arange(len(offsets))] * 4).tolist()
        for i, head, a, b in zip(np.flatnonzero(cut).tolist(), heads, inner[:-1], inner[1:], strict=True):
            out[i] = (self._ids(head) if head else b"") + raw[a:b]
        return out


_missing = partial(is_, None)

#: Runs of plain white space, and rare white space; each is searched for as it stands.
_RUNS = ("  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f")
_WIDE = tuple("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _double_space(text: str) -> bool:
    return text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS) or not text.isascii() and any(r in text for r in _WIDE)


_resident: dict = {}


def resident(key, make):
    """What ``make`` gives, kept in the Python worker for its next tasks in place of what was kept before."""
    if key not in _resident:
        if _resident:
            _resident.clear()
            release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Give memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run: Callable, *, keeps: bool = False) -> Callable:
    """``run`` for mapInArrow, which leaves no unused memory behind in the worker.

    Workers serve one stage after the other.  Unless ``run`` ``keeps`` something resident itself,
    what an earlier stage kept goes first.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps and _resident:
            _resident.clear()
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def encoder(path: str) -> UnitEncoder:
    """One encoder for each Python worker and file."""
    return resident(("encoder", path), lambda: UnitEncoder(path))


#: Name of the row key that stages add and drop again.
ROW = "__holdfast_row"


def as_table(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a table of Parquet files, and its path; anything but a bare folder of them is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        roots = plan.relation().location().rootPaths()
        if roots.size() == 1:
            path = roots.head().toString()
            if {f.rpartition("/")[0].rstrip("/").split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()} == {path.rstrip("/").split(":", 1)[-1].lstrip("/")}:
                return docs, path
    return spill(docs, "table")


def named(columns: list[str]) -> list[Column]:
    """Columns by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free(table: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column."""
    taken = {c.lower() for c in table.columns}
    while name in taken:
        name += "_"
    return name


def place(table: DataFrame, part: str) -> Column:
    """``file_path`` or ``row_index`` of a table's rows, also beside a column called as the hidden one."""
    return table.metadataColumn("_metadata")[part]


def keyed(table: DataFrame, name: str = ROW) -> DataFrame:
    """A table's rows with their place (file and row) as a key that every read gives again."""
    return table.withColumn(name, F.struct(place(table, "file_path").alias("file"), place(table, "row_index").alias("row")))
