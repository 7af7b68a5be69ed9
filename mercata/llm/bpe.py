"""Byte-level BPE by per-prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its
encoding.  An Aho-Corasick automaton over the vocabulary (all tokens that are
a suffix at each place) lists the candidates; a candidate that starts at
place p is the one if it starts the piece or if it is compatible with the
last token stored for prefix p.  Two tokens are compatible if BPE, applied to
their joined bytes, gives back the two: undo the later of the two facing
merges again and again, and no facing pair may have a merge that BPE would
have done before the one undone last.  Following the stored tokens back from
the end gives the ids, exactly those of merge-by-rank BPE.

Prefixes of many pieces are handled at once with numpy, place by place,
longest candidates first.  Pieces come from the tokenizer's pre-tokenisation;
texts are first cut at single spaces between two visible signs, where the
pre-tokeniser always cuts, and each different cut is encoded once.

Edge cases: NULL and empty texts have no ids and decode to the empty text.
Added tokens in a text become their ids, as in the library.  Rows that repeat
are rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PieceMemo, SortedMemo, SpanHasher, spread, text_parts

_U = np.uint64
#: Pieces longer than this are encoded one by one, so that a very long run
#: of one kind of sign does not make the place-by-place loop long for all.
LONG_PIECE = 400


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: visible
    Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What encoding needs from a tokenizers JSON file, as plain arrays.

    ``tokens``: bytes of each id; ``left``, ``right``, ``rank``: the merge that
    makes a token (rank -1: none); ``pairs``, ``pair_rank``: merges by
    (left << 32 | right), sorted; ``added``: text of added tokens to ids.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    code = {s: b for b, s in enumerate(byte_signs())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *added.values()]) + 1
    tokens = [b""] * size
    for sign, i in vocab.items():
        tokens[i] = sign.encode() if sign in added else bytes(code[c] for c in sign)
    for sign, i in added.items():
        tokens[i] = sign.encode()
    left, right, rank = np.arange(size), np.arange(size), np.full(size, -1)
    pairs, ranks = [], []
    for r, pair in enumerate(merges):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        made = vocab[a + b]
        pairs.append(vocab[a] << 32 | vocab[b])
        ranks.append(r)
        if rank[made] < 0:
            left[made], right[made], rank[made] = vocab[a], vocab[b], r
    order = np.argsort(pairs)
    return {
        "tokens": tokens, "left": left, "right": right, "rank": rank,
        "pairs": np.array(pairs, np.int64)[order], "pair_rank": np.array(ranks, np.int64)[order],
        "added": added, "own": sorted({*vocab.values()} - {*added.values()}),
    }


class PrefixEncoder:
    """Encodes byte pieces; see the module's text."""

    MOST_PAIRS = 1_000_000

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.__dict__.update({k: vocabulary[k] for k in ("tokens", "left", "right", "rank", "pairs", "pair_rank")})
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        own = np.array(vocabulary["own"], np.int64)
        # A token that BPE would not make of its own bytes can never be the whole of a prefix.
        ends = self.rank[own] >= 0
        whole = np.ones(len(own), bool)
        whole[ends] = self._compatible(self.left[own[ends]], self.right[own[ends]], self.rank[own[ends]])
        self.machine = ahocorasick.Automaton()
        for i in own[whole & ((self.length[own] == 1) | ends)].tolist():
            self.machine.add_word(self.tokens[i].decode("latin-1"), i)
        self.machine.make_automaton()
        self.pairs_seen = SortedMemo(bool)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; beyond all ranks if there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], 1 << 40)

    def _compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border comes before the merges beside
        it (and, of rank under ``below`` if given, at all)."""
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 39) if below is None else below.copy()
        while len(live):
            clash = self._pair_rank(a, b) < limit
            fine[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb  # of two merges of one rank, BPE does the left one first, so the right one is undone first
            # Across the border, a pair of the undone merge's own rank lies to
            # the right of a's merge (later) and to the left of b's (earlier).
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return fine

    def _verdicts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32 | b).astype(_U)
        if len(self.pairs_seen) > self.MOST_PAIRS:
            self.pairs_seen.clear()
        known, (fine,) = self.pairs_seen.find(key)
        if not known.all():
            fresh = np.unique(key[~known])
            verdict = self._compatible((fresh >> _U(32)).astype(np.int64), (fresh & _U(0xFFFFFFFF)).astype(np.int64))
            self.pairs_seen.add(fresh, verdict)
            fine[~known] = verdict[np.searchsorted(fresh, key[~known])]
        return fine

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, ids per piece)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        # One text of all pieces, with a sign between them that no token has.
        text = "Ā".join([p.decode("latin-1") for p in pieces])
        found = np.fromiter((x for hit in self.machine.iter(text) for x in hit), np.int64).reshape(-1, 2)
        begin = np.cumsum(sizes + 1) - (sizes + 1)  # of each piece in the text
        stop, token = found[:, 0] + 1, found[:, 1]
        piece = np.searchsorted(begin, found[:, 0], "right") - 1
        place = stop - begin[piece]  # the prefix length that the hit ends
        long = sizes[piece] > LONG_PIECE
        # last[begin + prefix length]: the unique last token; the slot before a piece is its separator's.
        last = np.full(len(text) + 2, -1, np.int64)
        order = np.lexsort((-self.length[token], stop, place))
        order = order[~long[order]]
        bounds = np.searchsorted(place[order], np.arange(1, int(place[order[-1]]) + 2)) if len(order) else [0]
        for lo, hi in zip(bounds, bounds[1:]):
            self._settle(last, stop, token, place, order[lo:hi])
        if long.any():
            self._settle_long(last, stop, token, place, np.flatnonzero(long))
        return self._follow(last, begin, sizes)

    def _settle(self, last, stop, token, place, hits) -> None:
        """Stores the last token of the prefixes that these hits end; hits of a
        prefix follow each other, the longest first."""
        while len(hits):
            heads = np.flatnonzero(np.diff(stop[hits], prepend=-1))
            head = hits[heads]
            size = self.length[token[head]]
            good = size == place[head]
            rest = ~good
            good[rest] = self._verdicts(last[stop[head[rest]] - size[rest]], token[head[rest]])
            last[stop[head[good]]] = token[head[good]]
            keep = np.ones(len(hits), bool)
            keep[heads] = False
            hits = hits[keep]
            hits = hits[last[stop[hits]] < 0]

    def _settle_long(self, last, stop, token, place, hits) -> None:
        """The same for long pieces, one place after another."""
        known: dict[tuple[int, int], bool] = {}
        order = np.lexsort((-self.length[token[hits]], stop[hits]))
        hits = hits[order]
        for at, t, n, size in zip(stop[hits].tolist(), token[hits].tolist(), place[hits].tolist(), self.length[token[hits]].tolist()):
            if last[at] >= 0:
                continue
            if size != n:
                pair = (int(last[at - size]), t)
                if pair not in known:
                    known[pair] = bool(self._verdicts(np.array([pair[0]]), np.array([pair[1]]))[0])
                if not known[pair]:
                    continue
            last[at] = t

    def _follow(self, last, begin, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Back-pointers from the ends of all pieces at once."""
        live = np.flatnonzero(sizes > 0)
        left, at = sizes[live].copy(), begin[live] + sizes[live]
        step_piece, step_token = [], []
        while len(live):
            t = last[at]
            if (t < 0).any():
                raise ValueError("a piece has bytes that the vocabulary can't encode")
            step_piece.append(live)
            step_token.append(t)
            left, at = left - self.length[t], at - self.length[t]
            go = left > 0
            live, left, at = live[go], left[go], at[go]
        if not step_piece:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        pieces = np.concatenate(step_piece)
        tokens = np.concatenate(step_token)
        order = np.argsort(pieces[::-1], kind="stable")  # steps run from the last token to the first
        return tokens[::-1][order], np.bincount(pieces, minlength=len(sizes))


class TextEncoder:
    """Ids of whole texts: cuts, pre-tokenisation, added tokens."""

    #: Fixed value: the pre-tokeniser's pattern of byte-level BPE with its own regex.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Fixed value: UTF-8 of white space beyond ASCII, and ASCII signs that some call white space.
    ODD_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"

    def __init__(self, vocabulary: dict, state: dict):
        import regex

        if "encoder" not in state:
            state.update(encoder=PrefixEncoder(vocabulary), memo=PieceMemo(), hasher=SpanHasher(key=secrets.randbits(64)))
        self.encoder, self.memo, self.hasher = state["encoder"], state["memo"], state["hasher"]
        self.added = vocabulary["added"]
        # An added token that is the start of another loses against it: longest first.
        self.any_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(self.PATTERN)
        self.odd = re.compile(self.ODD_SPACE)
        self.visible = np.ones(256, bool)
        self.visible[[*range(9, 14), *range(28, 33)]] = False
        self.lengths = self.encoder.length
        self.bytes = np.frombuffer(b"".join(self.encoder.tokens), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where every pre-tokenisation cuts: text borders, and single
        spaces between visible signs in texts without odd white space."""
        seen = self.visible[data]
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 32) & seen[:-2] & seen[2:]
        raw = data.tobytes()
        for m in self.odd.finditer(raw):
            k = int(np.searchsorted(offsets, m.start(), "right")) - 1
            cut[offsets[k] : offsets[k + 1]] = False
        if self.any_added is not None:  # an added token may hold a space; its text is one piece
            for a in self.added:
                if " " in a:
                    for m in re.finditer(re.escape(a.encode()), raw):
                        cut[m.start() : m.end()] = False
        borders = offsets[:-1][np.diff(offsets) > 0]
        # A space at a text's border has no sign on one side.
        inner = offsets[1:-1]
        cut[inner[inner < len(data)]] = False
        before = inner - 1
        cut[before[before >= 0]] = False
        cut[borders] = True
        return np.flatnonzero(cut)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by their pre-tokens, each different one encoded once."""
        place: dict[str, int] = {}
        sequence: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text] if self.any_added is None else self.any_added.split(text)
            for k, part in enumerate(parts):
                if k % 2:
                    found = [-1 - self.added[part]]
                else:
                    found = [place.setdefault(p, len(place)) for p in self.split.findall(part)]
                sequence.extend(found)
                counts[i] += len(found)
        ids, lengths = self.encoder.encode([p.encode("utf-8") for p in place])
        begins = np.cumsum(lengths) - lengths
        # Added tokens follow the pieces' ids in the pool.
        special = sorted(self.added.values())
        at = {t: len(ids) + k for k, t in enumerate(special)}
        pool = np.concatenate([ids, np.array(special, np.int64)])
        sequence_at = np.array(sequence, np.int64)
        is_added = sequence_at < 0
        first = np.where(is_added, [at.get(-1 - s, 0) for s in sequence] if is_added.any() else 0, begins[np.maximum(sequence_at, 0)] if len(begins) else 0)
        size = np.where(is_added, 1, lengths[np.maximum(sequence_at, 0)] if len(lengths) else 0)
        upto = np.concatenate([[0], np.cumsum(size)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return spread(pool, first.astype(np.int64), size), np.diff(upto[edges])

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ids per text) for runs of texts."""
        for row, end, data, offsets in text_parts(texts):
            starts = self._cuts(data, offsets)
            ends = np.append(starts[1:], len(data))[: len(starts)]

            def new(places, data=data, starts=starts, ends=ends):
                raw = data.tobytes()
                return self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[places].tolist(), ends[places].tolist())])

            ids, lengths = self.memo.ids(self.hasher(data, starts, ends), new) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            upto = np.concatenate([[0], np.cumsum(lengths)])
            yield row, end, ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, places of their starts and the end)."""
        lengths = self.lengths[ids]
        return spread(self.bytes, self.begins[ids], lengths), np.concatenate([[0], np.cumsum(lengths)])


def encode_and_decode(docs: DataFrame, vocabulary_path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    as asked for ids (little-endian unsigned 32-bit integers) and the decoded
    text."""
    # Bounded by the vocabulary; state is what a worker keeps between its tasks.
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": load_vocabulary(vocabulary_path), "state": {}})
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
    kinds = {"ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches):
        encoder = TextEncoder(shared.value["vocabulary"], shared.value["state"])
        for batch in batches:
            for row, end, found, counts in encoder.texts(batch.column(1)):
                data, place = encoder.decode(found)
                edges = np.concatenate([[0], np.cumsum(counts)])
                raw, text = found.astype("<u4").tobytes(), data.tobytes()
                at, to = (edges * 4).tolist(), place[edges].tolist()
                coded = [raw[a:b] for a, b in zip(at, at[1:])]
                back = [text[a:b].decode("utf-8", "replace") for a, b in zip(to, to[1:])]
                columns = [batch.column(0)[row:end], pa.array(counts.astype(np.int64))]
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()))
                columns.append(pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back], pa.string()))
                columns += [pa.array(coded, pa.binary())] * ids + [pa.array(back, pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
