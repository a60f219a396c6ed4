import random

import public_tokenizers
import pytest
from helpers import ODD, given, table

from quirelake.llm import pieces

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(public_tokenizers.path(MODEL))


def path_through(matrices):
    """(entry, exit) of each chunk by the same products, in plain Python."""
    if len(matrices) == 1:
        cell = matrices[0][0]
        return [(tuple(cell[:2]), tuple(cell[2:4]))]
    joined = [pieces.product(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)]
    out = []
    for k, (a, b) in enumerate(path_through(joined + matrices[2 * len(joined) :])):
        mid = next(tuple(c[4:]) for c in joined[k] if tuple(c[:4]) == (*a, *b)) if k < len(joined) else None
        out += [(a, b)] if mid is None else [(a, mid), (mid, b)]
    return out


def by_chunks(coder, text, size):
    whole = "▁" + text.replace(" ", "▁")
    cuts = list(range(0, len(whole), size))
    parts = [(whole[max(0, s - 32) : s + size + 32], min(s, 32), min(s, 32) + min(size, len(whole) - s)) for s in cuts]
    last = len(cuts) - 1
    matrices = [coder.matrix(t, a, b, k == 0, k == last) for k, (t, a, b) in enumerate(parts)]
    route = path_through([[[*a, *b] for a, b in m] for m in matrices])
    return [i for k, (t, a, b) in enumerate(parts) for i in coder.trace(t, a, b, k == 0, *route[k]).tolist()]


def texts():
    rng = random.Random(4)
    out = ["a" * 300, "ab" * 200, " " * 100, "Hello world, this is a text. " * 9, "日本語テキスト" * 20, "x \n\n y  z   " * 20, "supercalifragilistic" * 12]
    for alphabet in ["abcdeinrst", "ab ", "the and ing", "aé日😀 \n▁", "0123456789abcdef", "=-_.#*  "]:
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60, 400))) for _ in range(12)]
    return out


@pytest.mark.parametrize("size", [40, 64, 101])
def test_chunks_give_the_ids_of_the_whole(coder, size):
    for text in texts():
        assert by_chunks(coder, text, size) == coder.model.encode(text), repr(text)


def test_words_one_by_one_give_the_ids_of_the_whole(coder):
    import numpy as np

    for text in [*texts(), "", " ", "a", " a", "a ", "▁", "a▁ b", "<s> x"]:
        ids = np.frombuffer(coder.encode(text), np.uint16)
        assert ids.tolist() == coder.model.encode(text), repr(text)
        assert coder.decode(ids) == coder.model.decode(ids.tolist())


@pytest.mark.parametrize("size", [500, pieces.CHUNK])
def test_documents(spark, coder, size):
    docs = given(spark) if size > 500 else given(spark).limit(60).unionByName(table(spark, ODD))
    want = sorted((str(r.doc_id), coder.model.encode(r.text or ""), (r.text or "").replace("▁", " ")) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in pieces.encode(docs, size=size).collect()) == want


def test_empty_table(spark):
    assert pieces.encode(table(spark, [])).count() == 0


def test_many_chunks_of_one_text(spark, coder):
    """One text of some hundred chunks among shorter ones: eight levels of joins, the ids of the whole."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcde rst\n日") for _ in range(n))) for i, n in enumerate([20_000, 10_000, 900, 257, 128, 10])]
    want = [(i, coder.model.encode(t)) for i, t in rows]
    assert sorted((r.doc_id, list(r.ids)) for r in pieces.encode(table(spark, rows), size=128).collect()) == want
