import hashlib
import re

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.fingerprints import ALPHABET, common_subsequence, edited, fingerprint, fingerprints, likeness
from tablewright.llm.token_counts import MARK, Trie, Unigram, segmented, token_counts


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


signature = st.text(alphabet=ALPHABET[:5], max_size=64)


@settings(deadline=None)
@given(st.lists(st.tuples(signature, signature), min_size=1, max_size=20))
def test_bit_parallel_subsequence(pairs):
    assert common_subsequence(*map(list, zip(*pairs))).tolist() == [subsequence(a, b) for a, b in pairs]


@settings(deadline=None)
@given(st.text(max_size=300))
def test_fingerprint_form(text):
    block, one, two = fingerprint(text).split(":")
    assert int(block) % 3 == 0 and len(two) <= len(one) <= 64 and bool(one) == bool(text)
    assert likeness([fingerprint(text)], [fingerprint(text)])[0] == 1


def test_small_edits_change_little():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh "), 6000))
    near = text[:3000] + "XYZ" + text[3001:]
    other = "".join(rng.choice(list("abcdefgh "), 6000))
    a, b, c = map(fingerprint, (text, near, other))
    assert likeness([a, a, a], [b, c, fingerprint(text + other)]).round(1).tolist()[0] >= 0.9
    assert likeness([a], [c])[0] < 0.4 < 0.5 < likeness([a], [fingerprint(text + other)])[0]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        change = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        prints = [fingerprint(t) for t in (text, change, following)]
        near = [float(likeness([prints[0]], [p])[0]) for p in prints[1:]]
        out.append((doc_id, len(text), hashlib.sha256(change.encode()).hexdigest(), *prints[:2], *near))
    return sorted(map(str, out))


def test_fingerprints_of_all_documents(spark, awkward, clashing, empty):
    rows = [(r[0], r[1] or "") for r in awkward.select("doc_id", "text").collect()]
    for docs in (awkward, clashing):
        assert sorted(str(tuple(r)) for r in fingerprints(docs).collect()) == brute(rows)
    assert fingerprints(empty).count() == 0
    many = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    assert sorted(str(tuple(r)) for r in fingerprints(many).collect()) == brute([(r[0], r[1]) for r in many.select("doc_id", "text").collect()])
    one = awkward.filter("doc_id = 15")
    assert fingerprints(one).first()["near_next"] == 1 and edited("abc", "x") == "abx" and edited("", "x") == ""


def plain_count(model, token):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        size = len(token[end - 1].encode("utf-8", "surrogatepass"))
        options = [(best[end - 1][0] + model.byte * size, best[end - 1][1] + size)]
        options += [(best[s][0] + model.scores[token[s:end]], best[s][1] + 1) for s in range(end) if token[s:end] in model.scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1]


MODEL = Unigram.load("piece_bpe_32k.model")


@settings(deadline=None)
@given(st.lists(st.text(alphabet="theandiongsärß漢1.", min_size=1, max_size=12), min_size=1, max_size=20))
def test_shared_prefixes_give_the_scores_of_each_token_alone(tokens):
    trie = Trie(MODEL)
    for t in tokens:
        node = trie.insert(MARK + t)
        assert (trie.score[node], trie.count[node]) == plain_count(MODEL, MARK + t)


@settings(deadline=None)
@given(st.lists(st.text(alphabet="theandiongsärß漢\U0001f600\ud8001.", min_size=1, max_size=50), max_size=20))
def test_depth_by_depth_gives_the_scores_of_each_token_alone(tokens):
    tokens = [MARK + t for t in tokens]
    counts, scores = segmented(tokens, MODEL)
    assert list(zip(scores.tolist(), counts.tolist())) == [plain_count(MODEL, t) for t in tokens]


def test_vocabulary_has_no_control_pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert "<s>" not in MODEL.scores and "<0x41>" not in MODEL.scores and model.id_to_piece(1000) in MODEL.scores


def test_token_counts(awkward, clashing, empty):
    texts = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in awkward.filter("doc_id not in (8, 11, 12)").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in token_counts(awkward).collect()}
    for doc_id, words in texts.items():
        if doc_id is None:
            continue
        assert got[doc_id]["n_pretokens"] == len(words)
        assert got[doc_id]["n_tokens"] == sum(plain_count(MODEL, MARK + w)[1] for w in words)
    assert got[8]["n_tokens"] == 0 and got[12]["n_pretokens"] == 1
    small = token_counts(awkward, nodes=50)  # a new trie for nearly every batch changes nothing
    assert sorted(map(str, small.collect())) == sorted(map(str, token_counts(clashing).collect()))
    assert token_counts(empty).count() == 0
