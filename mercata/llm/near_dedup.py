"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct shingles of ``width`` words (A-Z in lower
case; with fewer words the whole sequence is one shingle).  Two documents are
linked if their sets' Jaccard similarity is at least ``percent`` per cent.

1. **Signatures.**  ``coordinates`` MinHash values per set.  Documents with
   equal sets form one class; from here on a class is one row.
2. **Postings.**  A class is posted under its (coordinate, value) pairs.  A
   pair that no other class has cannot collide and is left out; the others
   are ordered by how many classes have them, rarest first.
3. **Prefix merging.**  Two signatures that agree in at least ``matches``
   coordinates share a posting among the first (shared - matches + 1) of
   each, so only those prefixes are joined.
4. **Skip merging.**  Collisions in the prefixes are counted; a pair whose
   count plus what is left behind its last collision cannot reach
   ``matches`` is skipped, the others are counted on whole signatures.
5. **Confirmation.**  Pairs that reach ``matches`` are compared on their full
   sets; only confirmed links count.  Before that, and before a pair of the
   last step is a row at all, sketches of the full sets bound what two sets
   have in common from above (exactly: no link is lost); pairs that cannot
   be linked go there.

A posting list may hold a third of all classes, so lists are not expanded
into pairs.  First every member is paired with the list's smallest member
(linear); confirmed links are merged into components.  Then, round by round, a
list that still holds several components pairs its members with a member of
its first and one of its last component (linear too), until a round adds no
link.  Of lists that still hold several components, the members are compared by prefix
merging on their full sets, first by such rounds over the lists of shingles; then
only pairs of different components that pass its bound are looked at: all of
them, and exactly.  A pair within one
component would not change the result.

With 64 coordinates and 30 matches, two classes of similarity 0.75 (48
expected agreements) miss the threshold with probability below 1e-6, and that
falls fast with similarity.  Shingles are compared by 64-bit hash.

Edge cases: NULL text, empty text and text without words have the empty set
(n_shingles 0), are linked with nothing and are their own component.  Rows
that repeat a doc_id are one document for links and each row is returned.
NULL doc_id: component NULL, kept, linked with nothing.  Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .components import components, moved
from .words import SpanHasher, mixed, text_parts, word_spans

WIDTH, PERCENT = 5, 75
COORDINATES, MATCHES = 64, 30
SKETCH = 16  # 64-bit words
_U = np.uint64


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The set of a document, from its words' hashes: sorted 64-bit hashes."""
    if not len(words):
        return words
    weights = mixed(np.arange(width, dtype=_U) + _U(1)) | _U(1)
    if len(words) < width:
        return mixed((words * weights[: len(words)]).sum(keepdims=True) + _U(len(words)))
    total = np.zeros(len(words) - width + 1, _U)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * weights[k]
    return np.unique(mixed(total + _U(width)))


def document_sets(texts: pa.Array, width: int, hasher: SpanHasher):
    """The set of each text in turn."""
    for _, _, data, offsets in text_parts(texts):
        starts, ends, edges = word_spans(data, offsets)
        hashes = hasher(data, starts, ends)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            yield shingle_hashes(hashes[a:b], width)


def minhash(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Postings of a set: one 64-bit value per coordinate, coordinate in the
    upper bits so that values of different coordinates differ."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, _U)
    for a in range(0, len(values), 1 << 14):  # bounded memory for very long texts
        np.minimum(least, (values[a : a + (1 << 14)] * multipliers[:, None]).min(axis=1), out=least)
    bits = _U(max(1, int(len(multipliers) - 1).bit_length()))
    return ((least >> bits) | (np.arange(len(multipliers), dtype=_U) << (_U(64) - bits))).view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of how many of a set's hashes fall on each bit.  The sketches
    of two sets differ in at most as many bits as the sets do in hashes."""
    bits = np.bincount((values % _U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may_link(n: list, sketches: list, percent: int):
    """Whether two sets of these sizes and sketches can be linked: they have at
    most half of what is left of both sizes' sum without the differing bits."""
    differ = sum((F.bit_count(sketches[0][k].bitwiseXOR(sketches[1][k])) for k in range(1, SKETCH)), F.bit_count(sketches[0][0].bitwiseXOR(sketches[1][0])))
    return (100 + percent) * (n[0] + n[1] - differ) >= 2 * percent * (n[0] + n[1])


def signatures(docs: DataFrame, width: int = WIDTH, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, sketch) of every row."""
    multipliers = mixed(np.arange(coordinates, dtype=_U) + _U(1000)) | _U(1)

    def run(batches):
        hasher = SpanHasher(lower=True)
        for batch in batches:
            counts, keys, found, sketches = [], [], [], []
            for values in document_sets(batch.column(1), width, hasher):
                counts.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                found.append(minhash(values, multipliers) if len(values) else None)
                sketches.append(sketch(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (found, sketches))],
                ["doc_id", "n_shingles", "set_key", "signature", "sketch"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature array<long>, sketch array<long>")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, set_key, shingles): sorted hashes as binary."""

    def run(batches):
        hasher = SpanHasher(lower=True)
        for batch in batches:
            sets = [v.tobytes() for v in document_sets(batch.column(1), width, hasher)]
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "set_key", "shingles"])

    return _texts(docs).mapInArrow(run, "doc_id long, set_key binary, shingles binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, shingles_a, shingles_b), the pairs (a, b) that are linked; a
    doc_id with several texts may give a pair more than once."""

    def run(batches):
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shingles_a, shingles_b) of pairs (a, b)."""
    named = {s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"shingles_{s}")) for s in "ab"}
    return pairs.join(named["a"], "a").join(named["b"], "b")


def star_links(postings: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Confirmed links of each list's members to its smallest one."""
    ends = postings.groupBy("token").agg(F.min(F.struct("rep", "rest", "n_shingles")).alias("end"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = postings.join(ends, "token").where("rep <> end.rep")
    close = 100 * F.least("n_shingles", "end.n_shingles") >= percent * F.greatest("n_shingles", "end.n_shingles")
    counted = star.where(close).groupBy(F.least("rep", "end.rep").alias("a"), F.greatest("rep", "end.rep").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("rest", "end.rest")).alias("rest")
    )
    # Too few seen and too few left: skipped.  A count that saw only some of a
    # pair's shared postings may skip it wrongly; it comes again below.
    hopeful = counted.where(F.col("n") + F.col("rest") >= matches).select("a", "b")
    return _confirmed(hopeful, classes, sets, percent, matches)


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree and whose sets are linked."""
    sides = {s: classes.select(F.col("rep").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n_shingles", "signature", "sketch"))) for s in "ab"}
    agree = F.size(F.array_intersect("signature_a", "signature_b"))
    able = _may_link([F.col("n_shingles_a"), F.col("n_shingles_b")], [F.col("sketch_a"), F.col("sketch_b")], percent)
    pairs = pairs.join(sides["a"], "a").join(sides["b"], "b").where(able & (agree >= matches)).select("a", "b")
    return _similar(_with_sets(pairs, sets), percent)


def round_pairs(labelled: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs (a, b, of_a, of_b), with their components, of each list's members
    with two of its members, one of its first component and one of its last;
    pairs within a component, and pairs that met in too few lists, are left out."""
    end = F.struct("component", "rep", "n_shingles", "rest")
    ends = labelled.groupBy("token").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.component < hi.component")
    met = labelled.join(ends, "token").select("rep", "n_shingles", "component", "rest", F.explode(F.array("lo", "hi")).alias("end")).where("component <> end.component")
    close = 100 * F.least("n_shingles", "end.n_shingles") >= percent * F.greatest("n_shingles", "end.n_shingles")
    counted = met.where(close).groupBy(*_ordered("rep")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("rest", "end.rest")).alias("rest")
    )
    return counted.where(F.col("n") + F.col("rest") >= matches).select("a", "b", "of_a", "of_b")


def _ordered(key: str) -> list:
    """Columns (a, b, of_a, of_b) of a row and its ``end``: smaller key first."""
    first, last = (f(F.struct(key, "component"), F.struct(f"end.{key}", "end.component")) for f in (F.least, F.greatest))
    return [first[key].alias("a"), last[key].alias("b"), first["component"].alias("of_a"), last["component"].alias("of_b")]


def _merged(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(vertex, component) of the components of ``pairs`` that the links
    ``found`` among them put together."""
    return components(pairs.join(found, ["a", "b"], "left_semi").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


def open_links(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between members of lists that hold several components, and
    of different components: prefix merging on the full sets.

    Shingles are ordered by how many of these members have them, rarest
    first.  A pair needs at least percent / (100 + percent) of both sizes'
    sum in common, so its first common shingle must leave that many behind it
    in both orders; pairs without such a shingle are skipped."""
    spread = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    members = labelled.join(spread, "token", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct()
    rows = cut(_shingle_rows(members.join(sets, "doc_id")))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    mine = W.partitionBy("doc_id", "set_key")
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("holders", "shingle")) - 1  # unshared ones come first
    prefix = cut(
        rows.join(shared, "shingle").withColumn("left", F.col("n") - place)
        .where(100 * F.col("left") >= percent * F.col("n")).select("shingle", "doc_id", "set_key", "component", "n", "left")
    )
    # Linear passes first: places that not even the list's smallest member
    # makes good, then lists left with one component.
    enough = (100 + percent) * F.col("left") >= percent * (F.col("n") + F.col("least"))
    able = prefix.join(prefix.groupBy("shingle").agg(F.min("n").alias("least")), "shingle").where(enough).drop("least")
    able = cut(_in_several(able))
    # Rounds, linear too: members of a list with three of them, others in each
    # round, until a round adds no link.  A group whose members are linked here
    # and there becomes one component before all are compared.
    links = tried = None
    for turn in count():
        pairs = turn_pairs(able, percent, turn)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = cut(_similar(_with_sets(pairs, sets), percent))
        met = pairs.select("a", "b")
        tried = met if tried is None else cut(tried.unionByName(met))
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        able = cut(_in_several(moved(able, "component", _merged(pairs, found))))
    # What is left is joined with itself; a pair is a row only if the sketches
    # of its sets allow a link, not for each shingle that it has in common.
    able = cut(able.join(_sketches(able.select("doc_id", "set_key").distinct().join(sets, ["doc_id", "set_key"])), ["doc_id", "set_key"]))
    x, y = able.alias("x"), able.alias("y")
    need = percent * (F.col("x.n") + F.col("y.n"))
    met = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
        & ((100 + percent) * F.col("x.left") >= need) & ((100 + percent) * F.col("y.left") >= need)
        & _may_link([F.col("x.n"), F.col("y.n")], [F.col("x.sketch"), F.col("y.sketch")], percent),
    )
    pairs = met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = _similar(_with_sets(pairs, sets), percent).distinct()
    return rest if links is None else links.unionByName(rest)


def _in_several(able: DataFrame) -> DataFrame:
    """The places in lists that hold several components."""
    several = able.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    return able.join(several, "shingle", "left_semi")


def turn_pairs(able: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b, of_a, of_b), with their components, of each list's members
    with three of its members, others in each list and turn, that pass the bound."""
    weak = (100 + percent) * F.col("left") < 2 * percent * F.col("n")  # too far back for a partner of its size
    orders = [F.struct(weak, F.xxhash64("doc_id", "shingle", F.lit(3 * turn + k)), "doc_id") for k in range(3)]
    ends = able.groupBy("shingle").agg(F.array(*(F.min_by(F.struct("component", "doc_id", "n", "left"), order) for order in orders)).alias("ends"))
    # Tested before they are rows: most members have all three in their component.
    enough = lambda end: (100 + percent) * F.least("left", end["left"]) >= percent * (F.col("n") + end["n"])
    fit = F.filter("ends", lambda end: (end["component"] != F.col("component")) & enough(end))
    return able.join(ends, "shingle").select("doc_id", "component", F.explode(fit).alias("end")).select(*_ordered("doc_id")).distinct()


def _sketches(sets: DataFrame) -> DataFrame:
    """(doc_id, set_key, sketch)."""

    def run(batches):
        for batch in batches:
            found = [sketch(np.frombuffer(v.as_buffer(), _U)) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "set_key", "sketch"])

    return sets.select("doc_id", "set_key", "shingles").mapInArrow(run, "doc_id long, set_key binary, sketch array<long>")


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """(doc_id, set_key, component, n, shingle), one row per shingle."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                values = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(3)]
                n = np.array([len(v) for v in values])
                which = pa.array(np.repeat(np.arange(len(n)), n))
                columns = [part.column(k).take(which) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(n, n)), pa.array(np.concatenate(values))], ["doc_id", "set_key", "component", "n", "shingle"])

    return sets.select("doc_id", "set_key", "component", "shingles").mapInArrow(run, "doc_id long, set_key binary, component long, n long, shingle long")


def near_links(docs: DataFrame, members: DataFrame, width: int, percent: int, coordinates: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): links (a, b) between class representatives that give
    the same components as all links."""
    classes = cut(
        members.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "sketch")))
        .select("rep", "n_shingles", "signature", "sketch", "set_key")
    )
    tokens = classes.select("rep", "set_key", "n_shingles", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    ordered = (
        tokens.join(shared, "token").groupBy("rep", "set_key", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("tokens"))  # at most one per coordinate
        .where(F.size("tokens") >= matches)
    )
    postings = cut(
        ordered.select("rep", "n_shingles", F.size("tokens").alias("n_tokens"), F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - matches + 1)).alias("pos", "posting"))
        .select(F.col("posting.token").alias("token"), "rep", "n_shingles", (F.col("n_tokens") - F.col("pos") - 1).alias("rest"))
    )
    posted = postings.select("rep").distinct().withColumnRenamed("rep", "posted")
    texts = _texts(docs).join(posted, F.col("doc_id") == F.col("posted"), "left_semi")
    keys = classes.select(F.col("rep").alias("doc_id"), "set_key")
    sets = cut(full_sets(texts, width).join(keys, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"]))
    label = components(star_links(postings, classes, sets, percent, matches))
    labelled = cut(
        postings.join(label, F.col("rep") == F.col("vertex"), "left").select("token", "rep", "n_shingles", "rest", F.coalesce("component", "rep").alias("component"))
    )
    # The components found first stand for their links.
    links, tried = label.select(F.col("vertex").alias("a"), F.col("component").alias("b")), None
    while True:
        pairs = round_pairs(labelled, percent, matches)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))  # a refuted pair does not come again
        found = cut(_confirmed(pairs, classes, sets, percent, matches))
        if found.isEmpty():
            break
        met = pairs.select("a", "b")
        tried = met if tried is None else cut(tried.unionByName(met))
        links = links.unionByName(found)
        labelled = cut(moved(labelled, "component", _merged(pairs, found)))
    more = cut(open_links(labelled, sets, percent))
    return classes, links.unionByName(more)


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    members = cut(signatures(docs, width, coordinates))
    classes, links = near_links(docs, members, width, percent, coordinates, matches)
    # Documents of a class, and rows of a doc_id, hang together as well.
    ids = members.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_key").distinct()
    copies = ids.join(classes.select("set_key", "rep"), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(links.unionByName(copies))
    joined = members.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("vertex"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
