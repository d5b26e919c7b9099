"""The archive's encoder by words gives the library's ids, and asks the library for new pre-tokens only."""

import random
from types import SimpleNamespace

import brute
import numpy as np
import public_tokenizers
import pytest

from threadhaul.llm import token_archive
from threadhaul.llm.queries import BYTE_BPE, vocabulary_path

BYTES = vocabulary_path(BYTE_BPE)


def ids(encoder, texts):
    return [np.frombuffer(x, dtype=encoder.type).tolist() for x in encoder.encode(texts)]


def library_ids(texts, path=BYTES):
    tokenizer = brute.byte_tokenizer() if path == BYTES else token_archive._tokenizer(path)
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_among_all_kinds_of_white_space():
    rnd = random.Random(5)
    parts = ["word", "it's", "'s", "''ll", "12", "½x", "é", "ʼn", "漢字", "😀", ",", "--", "a.\nB", "\0", "\x1c", "\u180e", "\u200b", "<|endoftext|>", "x" * 60]
    spaces = [" "] * 30 + ["  ", "\n", " \n", "\n ", "\t", "\r\n", "\xa0", " \xa0", "\u3000", "\x85", "\u2028 ", "\n\n    ", ""]
    texts = ["", " ", "\n", "  ", " a", "a ", "a\n", "a\n b", "a \n", "a \nb", "a b", " a b ", "\n a", "b a\n", "b a\n b"]
    for _ in range(3_000):
        texts.append("".join(rnd.choice(parts) + rnd.choice(spaces) for _ in range(rnd.randrange(12))))
    encoder = token_archive.Encoder(BYTES)
    want = library_ids(texts)
    assert ids(encoder, texts) == want
    assert ids(encoder, texts[::-1]) == want[::-1]
    assert encoder.by_words and max(map(len, [*encoder.known, *encoder.pieces])) <= token_archive.MEMO_CHARS


def test_every_character_of_the_first_planes_at_the_borders():
    shown = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"{c} {c}a {c}{c} b{c} " for c in shown[at : at + 64]) for at in range(0, len(shown), 64)]
    assert ids(token_archive.Encoder(BYTES), texts) == library_ids(texts)


def test_generations_of_words(monkeypatch):
    monkeypatch.setattr(token_archive, "MEMO_ENTRIES", 20)
    monkeypatch.setattr(token_archive, "CHUNK", 7)
    rnd = random.Random(6)
    encoder = token_archive.Encoder(BYTES)
    for _ in range(40):
        texts = [" ".join(f"w{rnd.randrange(90)}," for _ in range(9)) for _ in range(4)]
        assert ids(encoder, texts) == library_ids(texts)
    assert len(encoder.known) + len(encoder.older) <= 2 * (20 + 4 * 9)


def test_long_strings_are_not_remembered_by_a_reader_that_stops():
    """As in a task: ids come first in the zip, so that the encoder is not asked beyond the last text."""
    texts = ["y" * 90 + " a " + "z" * 90, "a  b" * 40, "<|endoftext|>" + "text " * 40]
    encoder = token_archive.Encoder(BYTES)
    got = [np.frombuffer(x, dtype=encoder.type).tolist() for _, x in zip(range(3), encoder.encode(texts))]
    assert got == library_ids(texts)
    assert max(map(len, [*encoder.known, *encoder.pieces])) <= token_archive.MEMO_CHARS


def test_tasks_of_a_worker_share_what_is_known():
    assert token_archive._encoder(BYTES) is token_archive._encoder(BYTES)


def test_known_words_and_long_runs_do_not_send_a_text_to_the_library():
    encoder = token_archive.Encoder(BYTES)
    text = "First " + "some plain words, again some plain words; " * 20 + "z" * 128 + " and the end"
    want = ids(encoder, [text])
    asked = []
    library, tokenize = encoder.library, encoder.library.model.tokenize

    def batch(given, **options):
        asked.extend(given)
        return library.encode_batch_fast(given, **options)

    encoder.library = SimpleNamespace(encode_batch_fast=batch)
    encoder.tokenize = lambda shown: asked.append(shown) or tokenize(shown)
    assert ids(encoder, [text, text]) == want * 2 == library_ids([text]) * 2
    # The long run is not remembered; the words around it are.
    assert "".join(asked).count("plain") == 0 and sum(map(len, asked)) < 250


@pytest.mark.parametrize("name", ("word_bpe_49k.json",))
def test_other_vocabularies_get_whole_texts(name):
    path = public_tokenizers.path(name)
    texts = ["Some Words,  and MORE words it's 2024", "", " a\n b", "one two"]
    try:
        encoder = token_archive.Encoder(path)
        assert not encoder.by_words
        assert ids(encoder, texts) == library_ids(texts, path)
    finally:
        token_archive._tokenizer.cache_clear()


def test_read_without_ids_is_the_same_otherwise(spark, tmp_path):
    folder = str(tmp_path / "ids")
    docs = spark.createDataFrame([(2, "b c"), (None, None), (1, "a  b\n")], "doc_id long, text string")
    files = token_archive.write(docs, folder, BYTES, 2)
    full, short = token_archive.read(files, folder), token_archive.read(files, folder, with_ids=False)
    assert "ids" not in short.columns
    assert sorted(map(str, short.collect())) == sorted(map(str, full.drop("ids").collect()))
