"""Models made by hand, of both kinds and with each feature, against the library."""

import random

import numpy as np
import pytest

from gridstone.llm import sentencepiece_fst

sentencepiece = pytest.importorskip("sentencepiece")


def model(path, merges, rule, squeeze, byte_fallback, users, seed):
    """A made-up vocabulary over a few letters; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, proto = random.Random(seed), pb.ModelProto()
    if rule:
        proto.normalizer_spec.CopyFrom(pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 2 if merges else 1, byte_fallback
    kinds = pb.ModelProto.SentencePiece

    def add(piece, score=0.0, kind=kinds.NORMAL):
        proto.pieces.add(piece=piece, score=score, type=kind)

    add("<unk>", kind=kinds.UNKNOWN)
    for b in range(256) if byte_fallback else ():
        add(f"<0x{b:02X}>", kind=kinds.BYTE)
    for u in users:
        add(u, kind=kinds.USER_DEFINED)
    known = list("▁abcdef")
    for _ in range(130):
        piece = rng.choice(known) + rng.choice(known[1:7] if not merges else [k for k in known if k[0] != "▁"])
        if piece not in known and piece not in users:
            known.append(piece)
    for k, piece in enumerate(known[7:]):
        add(piece, -float(k) if merges else -rng.uniform(2, 12))
    for piece in known[:7]:
        add(piece, -1000.0 if merges else -rng.uniform(3, 8))
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("merges", [False, True])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("squeeze", "byte_fallback", "users"), [(True, True, ()), (False, True, ("<x>", "ab")), (True, False, ("<x>", "ab")), (False, False, ())])
def test_equals_the_library(tmp_path, merges, rule, squeeze, byte_fallback, users):
    path = model(tmp_path / "m.model", merges, rule, squeeze, byte_fallback, users, seed=3)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  ", "a b  c", "ＡＢＣ　ｄ ﬁ ①", "ab<x>cd ab", "é é ½", "日本", "▁a▁ b", "\n a\n", "x" * 50]
    texts += ["".join(rng.choice("abcdef  <x>\nＡé日") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    for t in texts:
        ids = library.encode(t)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, t
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), t


def test_unigram_path_is_the_lightest(tmp_path):
    """Against all segmentations of short words."""
    path = model(tmp_path / "m.model", False, None, False, True, (), seed=9)
    own, rng = sentencepiece_fst.Transducer(path), random.Random(2)

    def best(word):
        if not word:
            return 0.0
        return min(best(word[k:]) - own.score[word[:k]] for k in range(1, len(word) + 1) if word[:k] in own.score)

    for _ in range(200):
        word = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
        assert -sum(own.score[p] for p in own.path(word)) == pytest.approx(best(word), abs=1e-4)
