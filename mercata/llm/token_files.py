"""Token ids in bit-packed files.

File format::

    magic b"MTOK0001"
    blocks: each holds ``ids per block`` ids (the last may hold fewer), every id
        in ``bits`` bits, least significant bit first, padded to 8 bytes
    index: block offsets (blocks + 1 int64, in bytes from the file's start),
        doc_id of each document (int64), NULL flags (uint8 each, padded to 8),
        first id of each document and end (documents + 1 int64)
    trailer, little-endian 64-bit: bits, ids per block, ids, documents, blocks,
        place of the index; then the magic again

``bits`` is the least number that holds the vocabulary.  A block unpacks with
a few numpy operations, and ids [a, b) need only the blocks they touch.

Writing: texts are encoded in scan order, and only doc_id, a digest of the text
and the compressed ids go on, as a table in the shared folder.  That table is
range-partitioned by (doc_id, digest, row), so file k comes before file k + 1
and rows of one doc_id, or without one, are spread over files like all others.
Every attempt of a task writes a file of its own name, and only files that the
index names count, so a retried or speculative task is harmless.  Files go
through ``pyarrow.fs`` to any store it reaches; the index of the dataset is a
small Parquet table written by Spark with the running start of each file.

Edge cases: NULL and empty texts give only the end id.  NULL doc_id sorts
first.  Rows that repeat doc_id are separate documents, in the order of a digest
of their texts.  An empty table gives no documents.  Other columns are ignored.
"""

from __future__ import annotations

import secrets
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mercata.session import checkpoint_dir

from .common import cut
from .words import PieceMemo, SpanHasher, text_parts, word_spans

MAGIC = b"MTOK0001"
BLOCK_IDS = 4096
END_ID = 2
_U = np.uint64


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, padded to whole 64-bit words."""
    if not len(ids):
        return b""
    at = np.arange(len(ids), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    ids = ids.astype(_U)
    out = np.zeros((len(ids) * bits + 63) // 64 + 1, _U)
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[firsts]] = np.bitwise_or.reduceat(ids << shift, firsts)
    over = np.flatnonzero(shift + _U(bits) > _U(64))  # ids that cross into the next word, one per word
    out[word[over] + 1] |= ids[over] >> (_U(64) - shift[over])
    return out[:-1].tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    words = np.append(np.frombuffer(data, _U), _U(0))
    at = np.arange(count, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    high = np.where(shift == 0, _U(0), words[word + 1] << ((_U(64) - shift) & _U(63))) if count else words[:0]
    return ((words[word] >> shift | high) & _U((1 << bits) - 1)).astype(np.uint32)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class TokenFileWriter:
    """Writes one file; ids arrive document by document."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.offsets, self.doc_ids, self.counts = [len(MAGIC)], [], []
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0
        stream.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.extend(doc_ids)
        self.counts.append(counts)
        self.total += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block_ids:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        stop = len(ids) if end else len(ids) // self.block_ids * self.block_ids
        for a in range(0, stop, self.block_ids):
            block = pack(ids[a : min(stop, a + self.block_ids)], self.bits)
            self.stream.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
        self.rest, self.waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        firsts = np.concatenate([[0], np.cumsum(np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64))]).astype(np.int64)
        flags = np.array([d is None for d in self.doc_ids], np.uint8)
        self.stream.write(np.array(self.offsets, np.int64).tobytes())
        self.stream.write(np.array([d or 0 for d in self.doc_ids], np.int64).tobytes())
        self.stream.write(flags.tobytes() + bytes(-len(flags) % 8))
        self.stream.write(firsts.tobytes())
        trailer = [self.bits, self.block_ids, self.total, len(self.doc_ids), len(self.offsets) - 1, self.offsets[-1]]
        self.stream.write(np.array(trailer, np.int64).tobytes() + MAGIC)


class TokenFile:
    """Random access to one file: documents by place, ids by range."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        trailer = self.file.read_at(56, self.file.size() - 56)
        if trailer[48:] != MAGIC:
            raise ValueError(f"{path}: not a token file")
        self.bits, self.block_ids, self.ids, self.documents, blocks, index = np.frombuffer(trailer, np.int64, 6).tolist()
        n, flags = self.documents, self.documents + -self.documents % 8
        raw = self.file.read_at(8 * (blocks + 1) + 8 * n + flags + 8 * (n + 1), index)
        self.offsets = np.frombuffer(raw, np.int64, blocks + 1)
        at = 8 * (blocks + 1)
        nulls = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        self.doc_ids = pa.array(np.frombuffer(raw, np.int64, n, at), mask=nulls.astype(bool))
        self.firsts = np.frombuffer(raw, np.int64, n + 1, at + 8 * n + flags)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, -(-stop // self.block_ids)
        data, base = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a])), self.offsets[a]
        out = []
        for k in range(a, b):
            count = min(self.block_ids, self.ids - k * self.block_ids)
            out.append(unpack(data[self.offsets[k] - base : self.offsets[k + 1] - base], self.bits, count))
        return np.concatenate(out)[start - a * self.block_ids : stop - a * self.block_ids]


class WordEncoder:
    """Ids of words by the tokenizers library, each different word once.

    For a tokenizer that drops white space and pre-tokenises within words,
    the ids of a text are those of its words in order, so only new words go
    through the library.  Words are first cut where the pre-tokeniser cuts
    (letters, single digits, other signs), which leaves fewer different
    pieces; a word with an added token, with signs outside Latin script or
    not in NFC goes to the library whole.
    """

    #: Fixed value: where this tokenizer family cuts within a word.
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    MOST_PIECES = 600_000

    def __init__(self, spec: str, state: dict):
        import os
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if "tokenizer" not in state:
            tokenizer = Tokenizer.from_str(spec)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            state.update(tokenizer=tokenizer, added=regex.compile("|".join(map(regex.escape, added)) or r"(?!)"), pieces={}, memo=PieceMemo(), hasher=SpanHasher(key=secrets.randbits(64)))
        self.tokenizer, self.added, self.pieces, self.memo, self.hasher = (state[k] for k in ("tokenizer", "added", "pieces", "memo", "hasher"))
        self.cuts = regex.compile(self.CUTS)
        self.foreign = regex.compile("[^\\x00-ɏ]|Σ")
        self.nfc = unicodedata.is_normalized

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Many short texts at once, as pre-split words of one input."""
        out: list[list[int]] = [[] for _ in texts]
        step = 256
        for a in range(0, len(texts), step):
            got = self.tokenizer.encode(texts[a : a + step], is_pretokenized=True, add_special_tokens=False)
            for word, token in zip(got.word_ids, got.ids):
                out[a + word].append(token)
        return out

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, whole = [], []
        for word in words:
            if self.foreign.search(word) or self.added.search(word) or not self.nfc("NFC", word):
                whole.append(word)
                parts.append([word])
            else:
                parts.append(self.cuts.findall(word.lower()))
        known = self.pieces
        if len(known) > self.MOST_PIECES:
            known.clear()
        direct = {w: e.ids for w, e in zip(whole, self.tokenizer.encode_batch(whole, add_special_tokens=False))} if whole else {}
        missing = list({p for ps in parts for p in ps if p not in known and p not in direct})
        known.update(zip(missing, map(tuple, self._encode(missing))))
        lengths = np.zeros(len(words), np.int64)
        flat: list[int] = []
        for i, ps in enumerate(parts):
            before = len(flat)
            for p in ps:
                flat.extend(direct[p] if p in direct else known[p])
            lengths[i] = len(flat) - before
        return np.array(flat, np.int64), lengths

    def texts(self, texts: pa.Array):
        """(first row, end row, ids, ids per text) for runs of texts."""
        for row, end, data, offsets in text_parts(texts):
            starts, ends, words = word_spans(data, offsets)

            def new(places, data=data, starts=starts, ends=ends):
                raw = data.tobytes()
                return self._new([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[places].tolist(), ends[places].tolist())])

            ids, lengths = self.memo.ids(self.hasher(data, starts, ends), new)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            yield row, end, ids, np.diff(upto[words])


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes all texts with the tokenizer file and writes token files in
    ascending doc_id order; returns the dataset's index (part, path, documents,
    n_ids, start), also written to ``out_dir``/index."""
    import json

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    top = max([end_id, *json.loads(spec)["model"]["vocab"].values(), *(t["id"] for t in json.loads(spec)["added_tokens"])])
    bits = max(1, int(top).bit_length())
    shared = spark.sparkContext.broadcast({"spec": spec, "state": {}})  # of bounded size; state: what a worker keeps between its tasks

    kind = pa.uint16() if bits <= 16 else pa.uint32()
    width = kind.bit_width // 8

    def codec() -> pa.Codec:  # what moves is about two thirds of the ids' size
        return pa.Codec("zstd", compression_level=1)

    def encode(batches):
        encoder = WordEncoder(shared.value["spec"], shared.value["state"])
        for batch in batches:
            for row, end, ids, counts in encoder.texts(batch.column(2)):
                ids = np.insert(ids.astype(kind.to_pandas_dtype()), np.cumsum(counts), kind.to_pandas_dtype()(end_id))
                edges = np.concatenate([[0], np.cumsum(counts + 1)]) * width
                data, edges = ids.tobytes(), edges.tolist()
                packed = pa.array([codec().compress(data[a:b], asbytes=True) for a, b in zip(edges, edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], batch.column(1)[row:end], pa.array(counts + 1), packed], ["doc_id", "tie", "n", "ids"])

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, folder = filesystem(out_dir)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(f"{folder}/{name}") as stream:
            writer = TokenFileWriter(stream, bits, block_ids)
            for batch in batches:
                counts = batch.column(1).to_numpy()
                data = [codec().decompress(x, n * width, asbytes=True) for x, n in zip(batch.column(2).to_pylist(), counts.tolist())]
                writer.add(batch.column(0).to_pylist(), counts, np.frombuffer(b"".join(data), kind.to_pandas_dtype()))
            writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "path": f"{out_dir}/{name}", "documents": len(writer.doc_ids), "n_ids": writer.total}],
            pa.schema([("part", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("n_ids", pa.int64())]),
        )

    fs, folder = filesystem(out_dir)
    fs.create_dir(folder, recursive=True)
    text = F.col("text").cast("string")
    encoded = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(encode, "doc_id long, tie long, n long, ids binary")
    encoded = cut(encoded.withColumn("row", F.monotonically_increasing_id()), "none")
    order = ["doc_id", "tie", "row"]  # rows alike in all but the last have the same ids
    written = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    written = written.mapInArrow(write, "part long, path string, documents long, n_ids long")
    written.write.mode("overwrite").parquet(f"{out_dir}/files")
    files = spark.read.parquet(f"{out_dir}/files")
    index = files.withColumn("start", F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids"))  # one row per file
    index.write.mode("overwrite").parquet(f"{out_dir}/index")
    return spark.read.parquet(f"{out_dir}/index")


def read_token_files(index: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                a = 0
                while a < file.documents:  # runs of documents of about a million ids
                    b = max(a + 1, int(np.searchsorted(file.firsts, file.firsts[a] + (1 << 20), "right")) - 1)
                    firsts = file.firsts[a : b + 1]
                    ids = file.read(int(firsts[0]), int(firsts[-1])).astype("<u4").tobytes()
                    at = ((firsts - firsts[0]) * 4).tolist()
                    sums = [zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [file.doc_ids[a:b], pa.array(firsts[:-1] + start), pa.array(np.diff(firsts)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = b

    files = index.where("documents > 0").select("path", "start").repartition("path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for a dataset, in the shared checkpoint folder."""
    root = checkpoint_dir(spark, create_if_unset=True)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/tokens-{uuid.uuid4().hex}"
