import functools

from polyspark.llm import sentencepiece_codec as sp

V = sp.load_vocabulary()


def best_score(codec, s):
    """The best score of any segmentation, by plain recursion over ends."""
    score = {p: x for p, x, ok in zip(V.pieces, V.scores, V.usable) if ok}

    @functools.cache
    def best(n):
        if n == 0:
            return 0.0
        out = best(n - 1) + codec.unknown if s[n - 1] not in codec.singles else float("-inf")
        return max([out, *(best(n - k) + score[s[n - k : n]] for k in range(1, min(n, 20) + 1) if s[n - k : n] in score)])

    return best(len(s))


def test_scores_are_optimal():
    codec = sp.Codec(V)
    byte_of = set(V.byte_ids)
    for text in ("hello", "the quick brown fox", "internationalisation", "Größe über", "aaaaaaa", "x🙂y", "12345.678"):
        for part in text.split(" "):
            s = sp.MARK + part
            ids = codec.viterbi(s)
            unknown = sum(c not in codec.singles for c in s)
            got = sum(V.scores[i] for i in ids if i not in byte_of) + unknown * codec.unknown
            assert abs(got - best_score(codec, s)) < 1e-4
            assert codec.decode(codec.encode(part)) == part


def test_round_trip(docs, none):
    coded = sp.encode(docs, check=True)
    rows = sp.decode(coded).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.round_trip and r.decoded == r.text and r.n_pieces == len(r.ids or []) and (r.ids is None) == (r.text is None)
    assert sp.encode(none).count() == 0
