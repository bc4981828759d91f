import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.BpeModel(open(PATH, encoding="utf-8").read())
TEXTS = [
    "", " ", "Hello, WORLD! it's we'll DON'T '''s 123", "<|startoftext|>Hi<|endoftext|><|endoftext|> x <|endoftext", "ΑΣ ΣΑΣ", "İ ﬁ e\u0301 ½ ² Ⅷ",
    "a" * 3000 + "b" * 2000, "日本語テキスト\u3000x\x1c\x1dy\u200bz\x85q", "🙂👩‍👩‍👧" * 50, "\u0130\ufb03\u00df", "word " * 4000,
]


def _check(texts):
    ids, offsets = MODEL.encode_batch(texts)
    for i, text in enumerate(texts):
        assert LIBRARY.encode(text or "", add_special_tokens=False).ids == ids[offsets[i]: offsets[i + 1]].tolist(), text[:50]


def test_ids_equal_the_librarys():
    _check(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))), max_size=4))
def test_ids_equal_the_librarys_on_any_text(texts):
    _check(texts)


def test_encode_and_decode_rows(spark, docs):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[2]])]
    out = bpe.decode(bpe.encode(docs(rows), PATH), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = LIBRARY.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert list(r.ids) == expected and r.decoded == LIBRARY.decode(expected, skip_special_tokens=False)
        assert r.text == rows[r.doc_id][1]
    assert bpe.decode(bpe.encode(docs([]), PATH), PATH).count() == 0


def test_memo_starts_anew_without_changing_results(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    for text in TEXTS[:6]:
        _check([text])
