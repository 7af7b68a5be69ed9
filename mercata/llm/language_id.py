"""Language ID by prediction by partial matching (PPM).

For every language a byte context tree of depth up to ``order`` holds how
often each byte followed each context.  A text's code length under a language
is the sum of its bytes' code lengths: a byte seen in the longest known
context costs its share there; otherwise an escape (PPM method C, with
exclusion of what longer contexts hold) is paid and the next shorter context
is asked, down to a uniform choice among the bytes never seen.  The
statistics are frozen, so a byte's code length depends only on the ``order``
bytes before it; texts are scored exactly, in runs that each look back that
far, and whole texts count.  The language of the shortest code wins.

For speed each language's tree is compiled into an automaton of its own: a
state is a context, with the next state and the code length for each byte, in
units of 1/4096 bit.  A language's automaton depends on its own texts alone.

Learning: from a sample of ``train_docs`` labelled documents per language
(expected number; chosen by a hash of doc_id, all documents if there are
fewer), counted in Spark.  Both bounds hold for each language: at most
``ngrams`` of its counted strings come to the driver and at most ``states`` of
its contexts make its automaton, the most frequent ones, all of one frequency
or none.  The strings are broadcast; each Python worker compiles them once.

Edge cases: NULL text and texts without a letter get ``und`` with score 0, as
does everything if nothing could be learned.  Rows with NULL lang teach
nothing; NULL doc_id counts as the empty string for the hashes.  Equal code
lengths go to the language first in code-point order.  Repeated rows are
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .words import text_parts

ORDER, TRAIN_DOCS, NGRAMS, STATES = 4, 1000, 500_000, 50_000
UNKNOWN = "und"
UNIT = 4096
RUN_BYTES = 512


def held_out(doc_id: Column) -> Column:
    """Documents set aside: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def count_ngrams(sample: DataFrame, order: int) -> DataFrame:
    """(lang, code, n): strings of 1 to order + 1 bytes within texts; code is
    the bytes in base 256 with a leading 1."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, _, data, offsets in text_parts(texts):
                    code = np.ones(len(data), np.int64)
                    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes from here to the text's end
                    for k in range(order + 1):
                        code = code[: len(data) - k] * 256 + data[k:]
                        found, n = np.unique(code[left[: len(code)] > k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n, pa.int64())], ["lang", "code", "n"])

    return sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, ngrams: int = NGRAMS, states: int = STATES) -> dict:
    """The automata, from the texts and languages of labelled documents that
    are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit("train"), "doc_id").alias("h")
    )
    rows = labelled.groupBy("lang").count()
    chance = rows.select(F.col("lang").alias("of"), (F.lit(float(train_docs)) / F.col("count")).alias("chance"))
    sample = labelled.join(F.broadcast(chance), F.col("lang") == F.col("of")).where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("chance"))
    return compile_trees(most_frequent(cut(count_ngrams(sample.select("lang", "text"), order)), ngrams).toArrow(), order, states)


def most_frequent(counts: DataFrame, ngrams: int) -> DataFrame:
    """At most ``ngrams`` strings of each language; all of one frequency or
    none, so that every string's beginnings and endings stay too."""
    upto = F.sum("strings").over(W.partitionBy("lang").orderBy(F.desc("n")))  # over one row per frequency
    kinds = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("strings")).withColumn("upto", upto)
    least = kinds.where(F.col("upto") <= ngrams).groupBy(F.col("lang").alias("of")).agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(least), (F.col("lang") == F.col("of")) & (F.col("n") >= F.col("least"))).select("lang", "code", "n")


def compile_trees(counts, order: int, states: int) -> dict:
    """The model of counted strings (lang, code, n), an Arrow table or a pandas
    frame.  It holds the strings, which are much smaller than the automata."""
    table = counts if isinstance(counts, pa.Table) else pa.Table.from_pandas(counts, preserve_index=False)
    named = table["lang"].cast(pa.string()).combine_chunks().dictionary_encode()
    names, which = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)
    code, n = table["code"].to_numpy(), table["n"].to_numpy()
    langs = sorted(names)
    parts = [which == names.index(lang) for lang in langs]
    return {"langs": langs, "order": order, "states": states, "strings": [(code[part], n[part]) for part in parts]}


def automata(model: dict) -> list[dict]:
    """The automaton of each language, compiled once a process."""
    if "automata" not in model:
        model["automata"] = [compile_tree(code, n, model["order"], model["states"]) for code, n in model["strings"]]
    return model["automata"]


def share(docs: DataFrame, model: dict):
    """Broadcast of the strings, at most ``ngrams`` of each language; a worker compiles them."""
    return docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "automata"})


def compile_tree(code: np.ndarray, n: np.ndarray, order: int, states: int) -> dict:
    """One language's automaton: by state and symbol, the next state's row
    (upper 32 bits) and the code length (lower 32 bits)."""
    by = np.argsort(code)
    code, n = code[by], n[by]
    edge = np.searchsorted(code, 1 << 8 * np.arange(order + 3, dtype=np.int64))  # strings of k bytes lie from edge[k] to edge[k + 1]
    # The most frequent contexts; all of one frequency or none, so that every
    # context's beginnings and endings are contexts too.
    by_count = np.sort(n[edge[1] : edge[order + 1]])[::-1]
    least = by_count[states] + 1 if len(by_count) > states else 0
    levels = [np.ones(1, np.int64)]
    for k in range(1, order + 1):
        c = code[edge[k] : edge[k + 1]][n[edge[k] : edge[k + 1]] >= least]
        ending = c & ((1 << 8 * (k - 1)) - 1) | 1 << 8 * (k - 1)
        levels.append(c[np.isin(c >> 8, levels[-1]) & np.isin(ending, levels[-1])])
    used = code[edge[1] : edge[2]] & 255
    symbol = np.full(256, len(used), np.uint8 if len(used) < 256 else np.int16)  # the last symbol: bytes never seen
    symbol[used] = np.arange(len(used))
    width = len(used) + 1
    first = np.cumsum([0, *map(len, levels)])
    table = np.empty((first[-1], width), np.int64)
    for k, contexts in enumerate(levels):
        # Times that each symbol followed; one row per context.
        string, times = code[edge[k + 1] : edge[k + 2]], n[edge[k + 1] : edge[k + 2]]
        row = np.searchsorted(contexts, string >> 8)
        fine = row < len(contexts)
        fine[fine] = contexts[row[fine]] == string[fine] >> 8
        seen = np.zeros((len(contexts), width), np.float32)
        seen[row[fine], symbol[string[fine] & 255]] = times[fine]
        bits, after = np.empty_like(seen), np.empty_like(seen)  # after: code length once the context was escaped from
        step = np.zeros((len(contexts), width), np.int32)
        if k:
            up = np.searchsorted(levels[k - 1], contexts & ((1 << 8 * (k - 1)) - 1) | 1 << 8 * (k - 1))
        for a in range(0, len(contexts), 4096):  # bounded memory
            part = slice(a, a + 4096)
            own = seen[part]
            if k:
                rest = np.where(own > 0, 0, shorter_seen[up[part]])
                after[part] = coded(rest, shorter_after[up[part]])
                bits[part] = np.where((own > 0).any(axis=1)[:, None], coded(own, after[part]), shorter_bits[up[part]])
                step[part] = shorter_step[up[part]]
            else:
                after[part] = np.log2(max(1, 256 - (own > 0).sum()))
                bits[part] = coded(own, after[part])
        if k < order:
            longer = levels[k + 1]
            step[np.searchsorted(contexts, longer >> 8), symbol[longer & 255]] = first[k + 1] + np.arange(len(longer))
        table[first[k] : first[k + 1]] = (step.astype(np.int64) * width << 32) | np.rint(bits * UNIT).astype(np.int64)
        shorter_seen, shorter_after, shorter_bits, shorter_step = seen, after, bits, step
    return {"symbol": symbol, "table": table.ravel()}


def coded(times: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """Code length of each symbol by its count in a row, or by an escape where
    it has none; a row without counts costs no escape."""
    total, kinds = times.sum(axis=1, dtype=np.float64)[:, None], (times > 0).sum(axis=1)[:, None]
    escape = np.log2((total + kinds) / np.maximum(kinds, 1), where=kinds > 0, out=np.zeros_like(total))
    return np.where(times > 0, np.log2((total + kinds) / np.maximum(times, 1), where=kinds > 0, out=np.zeros(times.shape)), escape + escaped)


def code_lengths(model: dict, data: np.ndarray, offsets: np.ndarray, run_bytes: int = RUN_BYTES) -> np.ndarray:
    """Code length of each text under each language, in bits."""
    order = model["order"]
    sizes = np.diff(offsets)
    runs = -(-sizes // run_bytes)
    text = np.repeat(np.arange(len(sizes)), runs)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin, length = offsets[text] + nth * run_bytes, np.minimum(run_bytes, sizes[text] - nth * run_bytes)
    by = np.argsort(-length, kind="stable")
    text, begin, length, back = text[by], begin[by], length[by], np.where(nth[by] > 0, min(order, run_bytes), 0)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left").tolist()
    out = np.zeros((len(sizes), len(model["langs"])))
    for lang, automaton in enumerate(automata(model)):
        symbols, table = automaton["symbol"][data], automaton["table"]
        state = np.zeros(len(text), np.int64)
        for k in range(min(order, run_bytes), 0, -1):  # the bytes before a run lead to its state
            some = np.flatnonzero(back >= k)
            state[some] = table[state[some] + symbols[begin[some] - k]] >> 32
        total = np.zeros(len(text), np.int64)
        for k, n in enumerate(live):
            at = table[state[:n] + symbols[begin[:n] + k]]
            total[:n] += at & 0xFFFFFFFF
            state[:n] = at >> 32
        np.add.at(out[:, lang], text, total / UNIT)
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Scorer:
    """Predictions for Arrow arrays of texts."""

    def __init__(self, model: dict):
        self.model = model
        self.names = np.array([*model["langs"], UNKNOWN], object)
        self.ascii_letters = np.zeros(256, bool)
        self.ascii_letters[[*range(65, 91), *range(97, 123)]] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text."""
        best, score = np.full(len(texts), len(self.names) - 1), np.zeros(len(texts))
        if self.model["langs"]:
            for row, end, data, offsets in text_parts(texts):
                letters = np.concatenate([[0], np.cumsum(self.ascii_letters[data])])
                some = np.diff(letters[offsets]) > 0
                for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
                    some[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                bits = code_lengths(self.model, data, offsets)
                first = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), first]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                best[row:end], score[row:end] = np.where(some, first, len(self.names) - 1), np.where(some, share, 0.0)
        return self.names[best], score


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the language's share
    if each had been as likely before reading the text)."""
    shared = share(docs, model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, score = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language
    with at least this score; one pass, no shuffle."""
    shared, names = share(docs, model), docs.columns
    at = names.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, score = scorer(batch.column(at))
            yield batch.filter(pa.array((langs != UNKNOWN) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Learns from the table's labelled documents and predicts all: doc_id,
    held_out, lang_pred, score."""
    out = predict(docs, learn(docs, **bounds))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
