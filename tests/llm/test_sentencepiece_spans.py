import random
import unicodedata

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from polynym.llm import sentencepiece_spans as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "Hello world", " leading", "trailing ", "a  b   c", "▁x ▁▁y", "tabs\tand\nlines\r\n", "né à l'été", "日本語 テキスト", "🙂🙂 ok", "\x00nul", "ﬁ ２ ①", "é ñ", "</s> <s> <0x41>", "word " * 300, "x" * 5000]


def random_text(rnd):
    return "".join(rnd.choice(" ab  cdé▁\n\tüß漢字🙂ﬁ①　 ​") for _ in range(rnd.randint(0, 60)))


def test_ids_and_spans_equal_the_library():
    rnd = random.Random(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = S.Encoder(S.read_model(MODEL), cache=50)
    for text in TEXTS + [random_text(rnd) for _ in range(400)]:
        ids, starts, ends = enc.encode(text)
        assert ids.tolist() == sp.encode(text), text
        raw = text.encode()
        assert (starts[1:] == ends[:-1]).all() and (not len(ids) or (starts[0], ends[-1]) == (0, len(raw)))
        for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            piece = sp.id_to_piece(i)
            assert raw[a:b] in (piece.replace("▁", " ").encode(), piece.encode(), piece[1:].encode(), bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"") or piece.startswith("▁")


def test_character_map_equals_the_library():
    """Longest-prefix normalisation through the maps that come with the library."""
    rnd = random.Random(4)
    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = lib.serialized_model_proto()
        enc = S.Encoder.__new__(S.Encoder)
        normalizer = {}
        for field, value in S._fields(spec):
            if field == S.NORMALIZER:
                normalizer |= dict(S._fields(value))
        enc.map = S.CharacterMap(normalizer[S.CHARSMAP])
        assert enc.map.units
        enc.user, enc.space, enc.suffix = [], b" ", False
        enc.dummy_prefix, enc.remove_spaces = False, False
        lib = sentencepiece.SentencePieceNormalizer(model_proto=spec, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
        for text in TEXTS + [random_text(rnd) for _ in range(300)]:
            normal, origin = enc.normalize(text.encode())
            assert normal.decode() == lib.normalize(text), (rule, text)
            assert len(origin) == len(normal) + 1 and (origin[1:] >= origin[:-1]).all()


def _field(number, value):
    """A length-delimited protobuf field."""
    size, out = len(value), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + value


def test_spans_through_a_character_map():
    """The model with a map: later fields of a protobuf message replace or add to earlier ones."""
    rnd = random.Random(6)
    normalizer = next(dict(S._fields(v)) for f, v in S._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if f == S.NORMALIZER)
    proto = S.read_model(MODEL) + _field(S.NORMALIZER, _field(S.CHARSMAP, normalizer[S.CHARSMAP]))
    lib, enc = sentencepiece.SentencePieceProcessor(model_proto=proto), S.Encoder(proto)
    mapped = 0
    for text in ["of ﬁve ２３ ℌello", "ＡＢＣ ﬂow ①②", "½ ㎏", *TEXTS, *(random_text(rnd) for _ in range(300))]:
        ids, starts, ends = enc.encode(text)
        assert ids.tolist() == lib.encode(text), text
        raw = text.encode()
        assert (starts <= ends).all() and (starts[1:] >= starts[:-1]).all() and (not len(ids) or ends[-1] <= len(raw))
        for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            piece, source = lib.id_to_piece(i), raw[a:b].decode(errors="replace")
            if piece.isascii() and piece.isalnum() and source and not source.isascii() and "\ufffd" not in source:
                whole = unicodedata.normalize("NFKC", source)
                assert piece in whole or whole in piece, (text, piece, source)
                mapped += 1
    assert mapped > 5


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (3, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.decode(S.encode(docs, MODEL), MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in out.collect()), key=str)
    want = sorted(((i is None, i or 0, sp.encode(t or "", add_eos=True), sp.decode(sp.encode(t or "", add_eos=True))) for i, t, _ in rows), key=str)
    assert got == want
    assert S.encode(docs.where(F.lit(False)), MODEL).count() == 0

    more = S.encode(docs, MODEL).selectExpr("doc_id", "IF(doc_id = 3, NULL, ids) AS ids", "'old' AS decoded")
    assert {(r.ids is None, r.decoded is None) for r in S.decode(more, MODEL).collect()} == {(True, True), (False, False)}
    assert "old" not in {r.decoded for r in S.decode(more, MODEL).collect()}
