"""Substring dedup with sharded automata of repeated phrases.

A window is ``width`` consecutive words of one document.  A word is removed if
a window that covers it also starts in a document with a smaller doc_id.

1. **Anchors.**  Of each window the word 5-gram with the smallest hash is its
   anchor (a minimiser): equal windows have equal anchors, and neighbouring
   windows mostly share one, so there are about 0.2 anchors a word.  Anchors
   that only one document has cannot lie in a repeated window.  An anchor
   held by a large share of some batch's documents is frequent; at most
   ``frequent`` of these are broadcast and kept out of the shuffle.
2. **Candidate phrases.**  A run of windows with one repeated anchor gives one
   phrase, keyed by the anchor.  Anchors with more than ``holders`` holders
   give each window as a phrase of its own, keyed by the window, so that no
   key has more than ``holders`` different phrases.  Equal phrases are grouped
   (partial aggregates) and keep their smallest and largest doc_id.
3. **Automata.**  Keys are dealt to shards of about ``shard_phrases`` phrases.
   A shard confirms its recurring windows, compiles them into an Aho-Corasick
   automaton over word ids (pyahocorasick), and streams its phrases through it:
   every hit is an occurrence, equal word for word, with the smallest doc_id
   that has the window.
4. **Removal.**  Hits go back to the phrases' documents, those of smaller
   doc_ids count, and every covered word goes.  Windows are judged on the input.

All steps cover all documents; broadcasts are bounded by parameters.

Edge cases: NULL text has no words.  Texts of fewer than ``width`` words keep
all.  Rows that repeat a doc_id are the same document, so they never remove
each other's words.  Rows with NULL doc_id keep all words and are no earlier
document for others.  Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .words import SpanHasher, mixed, text_parts, word_spans

WIDTH, GRAM = 13, 5
HOLDERS, SHARD_PHRASES, FREQUENT = 2000, 2500, 1024
#: A batch reports an anchor that this share of its documents has.
FREQUENT_SHARE = 0.005
_U = np.uint64


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, _U)
    for k, weight in enumerate(mixed(np.arange(size, dtype=_U) + _U(size * 1000)) | _U(1)):
        total += words[k : k + n] * weight
    return mixed(total)


class Windows:
    """All windows of a run of texts and their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, width: int, gram: int):
        self.data = data
        self.starts, self.ends, self.edges = word_spans(data, offsets)
        self.words = hasher(data, self.starts, self.ends)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.edges))
        n = max(0, len(text) - width + 1)
        self.at = np.flatnonzero(text[:n] == text[width - 1 :][:n])  # first word of each window
        grams = gram_hashes(self.words, gram)
        best, place = grams[self.at], self.at.copy()
        for k in range(1, width - gram + 1):
            other = grams[self.at + k]
            less = other < best
            best[less], place[less] = other[less], self.at[less] + k
        self.anchor, self.place, self.text = best.view(np.int64), place, text[self.at]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of each run of windows with one anchor's place."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero((np.diff(self.place, prepend=-1) != 0) | (np.diff(self.text, prepend=-1) != 0))
        return first, np.append(first[1:], len(self.at))

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, text) of each anchor of each text, once."""
        first, _ = self.runs()
        order = np.lexsort((self.anchor[first], self.text[first]))
        anchor, text = self.anchor[first][order], self.text[first][order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        return anchor[new], text[new]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text); row_key tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string").alias("text"))


def frequent_anchors(texts: DataFrame, width: int, gram: int, frequent: int) -> DataFrame:
    """(anchor): at most ``frequent`` anchors that a large share of some
    batch's documents has, all in more than one document."""

    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            found = []
            for _, _, data, offsets in text_parts(batch.column(0)):
                found.append(Windows(data, offsets, hasher, width, gram).postings()[0])
            anchors, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            some = n >= max(8, FREQUENT_SHARE * batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[some]), pa.array(n[some], pa.int64())], ["anchor", "n"])

    seen = texts.where("doc_id is not null").select("text").mapInArrow(run, "anchor long, n long")
    return seen.groupBy("anchor").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "anchor").limit(frequent).select("anchor")


def anchor_postings(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc_id, row_key, anchor), each anchor of a text once."""

    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            for row, end, data, offsets in text_parts(batch.column(2)):
                anchors, text = Windows(data, offsets, hasher, width, gram).postings()
                which = pa.array(text + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(anchors)], ["doc_id", "row_key", "anchor"])

    return texts.where("doc_id is not null").mapInArrow(run, "doc_id long, row_key long, anchor long")


def repeated_anchors(texts: DataFrame, width: int, gram: int, holders: int, frequent: int) -> DataFrame:
    """(doc_id, row_key, anchors, many): for each text its anchors that some
    other document has too; many: those with more than ``holders`` holders."""
    hot = cut(frequent_anchors(texts, width, gram, frequent))
    postings = anchor_postings(texts, width, gram)
    heavy = postings.join(F.broadcast(hot), "anchor", "left_semi").withColumn("many", F.lit(True))
    of = W.partitionBy("anchor")
    light = (
        postings.join(F.broadcast(hot), "anchor", "left_anti")
        .withColumn("lo", F.min("doc_id").over(of)).withColumn("hi", F.max("doc_id").over(of)).withColumn("n", F.count(F.lit(1)).over(of))
        .where("lo < hi").select("doc_id", "row_key", "anchor", (F.col("n") > holders).alias("many"))
    )
    both = heavy.select("doc_id", "row_key", "anchor", "many").unionByName(light)
    return both.groupBy("doc_id", "row_key").agg(  # at most the text's own anchors
        F.collect_list(F.when(~F.col("many"), F.col("anchor"))).alias("few"), F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("many")
    )


def candidate_phrases(texts: DataFrame, anchors: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, phrase, doc_id, row_key, start): runs of windows with repeated
    anchors; start is the phrase's first word in its text."""

    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            few, many = batch.column(3), batch.column(4)
            for row, end, data, offsets in text_parts(batch.column(2)):
                windows = Windows(data, offsets, hasher, width, gram)
                salt = mixed(np.arange(end - row, dtype=_U))
                of = lambda t, a: a.view(_U) ^ salt[t]  # noqa: E731  one number for text and anchor; a chance match only adds a candidate
                sets = []
                for column in (few, many):
                    part = column[row:end]
                    counts = np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1])
                    sets.append(of(np.repeat(np.arange(end - row), counts), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                first, stop = windows.runs()
                mark = of(windows.text[first], windows.anchor[first])
                runs = np.isin(mark, sets[0])
                single = np.isin(mark, sets[1])
                spread = np.repeat(single, stop - first)
                lone = np.flatnonzero(spread)
                grams = gram_hashes(windows.words, width)
                key = np.concatenate([windows.anchor[first[runs]], grams[windows.at[lone]].view(np.int64)])
                begin = np.concatenate([windows.at[first[runs]], windows.at[lone]])
                last = np.concatenate([windows.at[stop[runs] - 1], windows.at[lone]]) + width - 1
                text = np.concatenate([windows.text[first[runs]], windows.text[lone]])
                raw = data.tobytes()
                phrases = [b" ".join(raw[a:b].split()) for a, b in zip(windows.starts[begin].tolist(), windows.ends[last].tolist())]
                which = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(phrases, pa.binary()), batch.column(0).take(which), batch.column(1).take(which), pa.array(begin - windows.edges[text])],
                    ["key", "phrase", "doc_id", "row_key", "start"],
                )

    rows = texts.join(anchors, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "few", "many")
    return rows.mapInArrow(run, "key long, phrase binary, doc_id long, row_key long, start long")


def locate(phrases: list[bytes], first: np.ndarray, last: np.ndarray, width: int) -> pa.ListArray:
    """For each phrase and each of its windows, the smallest doc_id that has
    the window, or NULL if one document alone has it."""
    import ahocorasick

    ids: dict[bytes, int] = {}
    stream: list[int] = []
    sizes = []
    for phrase in phrases:
        words = phrase.split(b" ")
        sizes.append(len(words))
        stream.extend([ids.setdefault(w, len(ids) + 1) for w in words])
        stream.append(0)  # no pattern has it
    size = np.array(sizes)
    begin = np.cumsum(size + 1) - (size + 1)
    counts = size - width + 1
    owner = np.repeat(np.arange(len(phrases)), counts)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    hashes = gram_hashes(mixed(np.array(stream, np.int64).astype(_U)), width)[at]
    order = np.lexsort((first[owner], hashes))
    heads = np.flatnonzero(np.diff(hashes[order].view(np.int64), prepend=~hashes[order[:1]].view(np.int64)) != 0)
    low, high = first[owner][order][heads], np.maximum.reduceat(last[owner][order], heads)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    recurring = np.flatnonzero(low < high)
    for k, a in zip(recurring.tolist(), at[order[heads[recurring]]].tolist()):
        automaton.add_word(tuple(stream[a : a + width]), k)
    found, hit = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()), bool)
    if len(recurring):
        automaton.make_automaton()
        hits = np.fromiter((x for hit in automaton.iter(tuple(stream)) for x in hit), np.int64).reshape(-1, 2)
        places = hits[:, 0] - width + 1
        of = np.searchsorted(begin, places, "right") - 1
        window = places - begin[of] + (np.cumsum(counts) - counts)[of]
        found[window], hit[window] = low[hits[:, 1]], True
    edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(found, mask=~hit))


def _shard(width: int):
    def run(table: pa.Table) -> pa.Table:
        first, last = table["first"].to_numpy(), table["last"].to_numpy()
        found = locate(table["phrase"].to_pylist(), first, last, width)
        hits = np.concatenate([[0], np.cumsum(found.values.is_valid().to_numpy(zero_copy_only=False))])
        edges = found.offsets.to_numpy()
        out = pa.table({"key": table["key"], "phrase_key": table["phrase_key"], "firsts": found})
        return out.filter(pa.array(hits[edges[1:]] > hits[edges[:-1]]))

    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, holders: int = HOLDERS, shard_phrases: int = SHARD_PHRASES, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, row_key, starts): for each text the places of its windows that
    also start in a document with a smaller doc_id."""
    texts = _texts(docs)
    phrases = cut(candidate_phrases(texts, repeated_anchors(texts, width, gram, holders, frequent), width, gram), "zstd")
    shards = max(1, -(-phrases.count() // shard_phrases))
    distinct = phrases.groupBy("key", "phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    distinct = distinct.withColumn("phrase_key", F.xxhash64("phrase")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    hits = distinct.groupBy("shard").applyInArrow(_shard(width), "key long, phrase_key long, firsts array<long>")
    places = phrases.select("key", F.xxhash64("phrase").alias("phrase_key"), "doc_id", "row_key", "start").join(hits, ["key", "phrase_key"])
    earlier = F.filter(
        F.transform("firsts", lambda f, k: F.when(f < F.col("doc_id"), F.col("start") + k)), lambda s: s.isNotNull()
    )
    found = places.select("doc_id", "row_key", earlier.alias("starts")).where(F.size("starts") > 0)
    return found.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # at most the text's windows


def substring_dedup(docs: DataFrame, width: int = WIDTH, keep_text: bool = True, **bounds) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if
    asked for, kept_text (the kept words joined by one space)."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]

    def run(batches):
        for batch in batches:
            starts = batch.column(2)
            for row, end, data, offsets in text_parts(batch.column(1)):
                begins, ends, edges = word_spans(data, offsets)
                raw = data.tobytes()
                removed, kept = [], []
                for k in range(row, end):
                    a, b = int(edges[k - row]), int(edges[k - row + 1])
                    if starts[k].is_valid:
                        at = starts[k].values.to_numpy()
                        covered = np.zeros(b - a + 1, np.int64)
                        np.add.at(covered, at, 1)
                        np.add.at(covered, np.minimum(at + width, b - a), -1)
                        stay = a + np.flatnonzero(np.cumsum(covered[:-1]) == 0)
                        kept.append(b" ".join([raw[x:y] for x, y in zip(begins[stay].tolist(), ends[stay].tolist())]))
                        removed.append(b - a - len(stay))
                    else:
                        kept.append(b" ".join(raw[offsets[k - row] : offsets[k - row + 1]].split()))
                        removed.append(0)
                columns = [batch.column(0)[row:end], pa.array(np.diff(edges)), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                columns += [pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())] * keep_text
                yield pa.RecordBatch.from_arrays(columns, names)

    found = cut(repeated_windows(docs, width, **bounds))
    rows = _texts(docs).join(found, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
