"""Token counts by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token under a unigram model is found left to right: the
best score of a prefix is the best over all pieces that end there of the score before
the piece plus the piece's. Prefixes are shared: the pre-tokens that a run of texts brings
go into one trie, a node's forward score is computed once, and the node at which a
pre-token ends holds its token count. All nodes of a depth are scored together in numpy: those
of one depth are the distinct (parent, character) pairs, and the pieces that may end at a
node are found by the hashes of its last k characters among the pieces of k characters. Very long pre-tokens
(`DEEP`) are few and go one by one through a trie of Python dictionaries.

Pre-tokens that a task has met before are found by their hashes. A task keeps at most `NODES` of them and
then starts anew, which changes memory and time only. Nothing is shuffled.

The piece scores follow Zipf's law over the pieces' numbers in the vocabulary, which has no
scores of its own. They aren't fitted, so the counts are those of this model and not of
the program that the vocabulary belongs to.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .kernels import batches, mix, words

NODES = 400_000  # pre-tokens, or nodes of long ones, that a task remembers
DEEP = 64  # characters from which a pre-token is segmented on its own
RUN_BYTES = 8_000_000
MARK = "▁"  # begins every pre-token, as in the vocabulary
UNKNOWN = 10.0  # added cost of a byte of a character that no piece covers


class Unigram:
    """Pieces with log probabilities by Zipf's law over their rank in a public vocabulary."""

    def __init__(self, pieces: list[str]):
        rank = np.arange(len(pieces))
        logs = -np.log(rank + 2.7)
        logs -= np.log(np.exp(logs).sum())
        self.scores: dict[str, float] = {}
        for piece, score in zip(pieces, logs.tolist()):
            self.scores.setdefault(piece, score)
        self.longest = max(map(len, pieces), default=1)
        self.byte = (float(logs[-1]) if len(pieces) else 0.0) - UNKNOWN
        by: dict[int, list[tuple[int, float]]] = {}
        for piece, score in self.scores.items():
            if 0 < len(piece) < DEEP:
                h = int(_prefix_hashes(_points([piece]).reshape(1, -1))[0, -1])
                by.setdefault(len(piece), []).append((h, score))
        # Sorted hashes and scores of the pieces of each length.
        self.by_length = {k: tuple(np.array(c, t) for c, t in zip(zip(*sorted(v)), (np.uint64, float))) for k, v in by.items()}

    @classmethod
    def load(cls, name: str) -> Unigram:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        skip = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
        return cls([model.id_to_piece(k) for k in range(model.get_piece_size()) if not skip(k)])


class Trie:
    """Forward scores by node. A node is a number; its children are found by (node, character)."""

    def __init__(self, model: Unigram):
        self.model, self.child, self.score, self.count = model, {}, [0.0], [0]

    def insert(self, token: str) -> int:
        """The node at which the token ends."""
        path, node = [0], 0
        for end, character in enumerate(token, 1):
            key = node * 0x110000 + ord(character)
            node = self.child.get(key)
            if node is None:
                node = self.child[key] = self._extend(path, token, end)
            path.append(node)
        return node

    def _extend(self, path: list[int], token: str, end: int) -> int:
        scores, pieces = self.score, self.model.scores
        # A character on its own may be spelled in bytes, so every prefix has a segmentation.
        size, before = len(token[end - 1].encode("utf-8", "surrogatepass")), path[end - 1]
        best, count = scores[before] + self.model.byte * size, self.count[before] + size
        for start in range(max(0, end - self.model.longest), end):
            piece = pieces.get(token[start:end])
            if piece is not None:
                score, tokens = scores[path[start]] + piece, self.count[path[start]] + 1
                if score > best or (score == best and tokens < count):
                    best, count = score, tokens
        scores.append(best)
        self.count.append(count)
        return len(scores) - 1


def _points(tokens: list[str]) -> np.ndarray:
    return np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)


_BASE = np.uint64(0x9E37_79B9_7F4A_7C15)


def _prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row; that of a substring follows from two of them."""
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    for k in range(points.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + mix(points[:, k].astype(np.uint64))
    return out


def segmented(tokens: list[str], model: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """(token counts, scores) of pre-tokens shorter than `DEEP`, by one trie scored depth by depth."""
    n = len(tokens)
    size = np.array(list(map(len, tokens)), np.int64)
    order = np.argsort(-size, kind="stable")  # those that reach a depth come first
    longest = int(size.max(initial=0))
    letters = np.zeros((n, longest), np.uint32)
    letters[np.arange(longest) < size[:, None]] = _points(tokens)
    letters, size = letters[order], size[order]
    hashes = _prefix_hashes(letters)
    power = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(longest, _BASE)))
    node = np.zeros((n, longest + 1), np.int32)  # of each token at each depth
    scores, counts = [np.zeros(1)], [np.zeros(1, np.int64)]
    for depth in range(1, longest + 1):
        reach = int(np.searchsorted(-size, -depth, side="right"))
        character = letters[:reach, depth - 1].astype(np.int64)
        _, first, of = np.unique(node[:reach, depth - 1].astype(np.int64) * 0x110000 + character, return_index=True, return_inverse=True)
        node[:reach, depth] = of
        point, parent = character[first], node[first, depth - 1]
        # A character on its own may be spelled in bytes, so every prefix has a segmentation.
        spelled = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        best, count = scores[-1][parent] + model.byte * spelled, counts[-1][parent] + spelled
        for k in range(1, min(depth, model.longest) + 1):
            if k not in model.by_length:
                continue
            known, value = model.by_length[k]
            end = hashes[first, depth] - hashes[first, depth - k] * power[k]
            at = np.minimum(np.searchsorted(known, end), len(known) - 1)
            hit = np.flatnonzero(known[at] == end)
            before = node[first[hit], depth - k]
            score, tokens_ = scores[depth - k][before] + value[at[hit]], counts[depth - k][before] + 1
            better = (score > best[hit]) | ((score == best[hit]) & (tokens_ < count[hit]))
            best[hit[better]], count[hit[better]] = score[better], tokens_[better]
        scores.append(best)
        counts.append(count)
    out = np.zeros(n, np.int64), np.zeros(n)
    for depth in range(longest + 1):
        ends = np.flatnonzero(size == depth)
        out[0][order[ends]], out[1][order[ends]] = counts[depth][node[ends, depth]], scores[depth][node[ends, depth]]
    return out


def _counted(found, name: str, nodes: int):
    model = Unigram.load(name)
    trie, hashes, table = Trie(model), np.zeros(0, np.uint64), np.zeros((0, 2))
    for batch in found:
        texts, columns = batch.column(1).to_pylist(), [[], [], []]
        for _, raws in batches(texts, RUN_BYTES):
            w = words(raws)
            distinct, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(hashes) > nodes or len(trie.score) > nodes:
                trie, hashes, table = Trie(model), np.zeros(0, np.uint64), np.zeros((0, 2))
            at = np.searchsorted(hashes, distinct)
            new = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] != distinct) if len(hashes) else np.arange(len(distinct))
            tokens = [MARK + w.string(i) for i in first[new].tolist()]
            own, deep = np.zeros((len(new), 2)), np.array([len(t) >= DEEP for t in tokens], bool)
            own[~deep, 0], own[~deep, 1] = segmented([t for t in tokens if len(t) < DEEP], model)
            for k in np.flatnonzero(deep).tolist():
                node = trie.insert(tokens[k])
                own[k] = trie.count[node], trie.score[node]
            hashes, table = np.insert(hashes, at[new], distinct[new]), np.insert(table, at[new], own, axis=0)
            ends = table[np.searchsorted(hashes, distinct)][back].reshape(-1, 2)
            columns[0].append(np.bincount(w.text, minlength=len(raws)))
            columns[1].append(np.bincount(w.text, ends[:, 0], len(raws)).astype(np.int64))
            columns[2].append(np.bincount(w.text, ends[:, 1], len(raws)))
        flat = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, (np.int64, np.int64, float))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in flat]], ["doc_id", "n_pretokens", "n_tokens", "log_score"])


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", nodes: int = NODES) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_score) of every text.

    Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+``, each with the mark of a word's begin. A
    character outside the vocabulary counts as its UTF-8 bytes. Among segmentations of
    equal score the shorter counts. Null and empty texts have no tokens; rows stay as they are, so repeated ones
    are counted alike; very long texts are read whole, other columns don't matter and an empty table gives none.
    ``vocabulary`` names a public vocabulary, whose pieces get scores by their numbers; ``nodes`` bounds
    what a task remembers.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_counted, name=vocabulary, nodes=nodes), "doc_id long, n_pretokens long, n_tokens long, log_score double")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
