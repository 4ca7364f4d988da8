"""Token files and packing against whole-text encoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from welfarelens.llm import encoding, packing, token_files
from welfarelens.llm.tables import new_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, with the same words again: words.", "", None, " ", "  two  leading and trailing  ", "tab\tand\nline \n\n end\n",
    "a   b", "it's they'll 'quoted' ''s", "Élan café ÇA İstanbul J̌ ΟΔΟΣ", "x" * 500, "<|endoftext|> as text", "a\x1cb\x85c d e",
    "é ̈x", "1234 5,678.90", "日本語 テキスト 🙂", "Straße, (Maß) Œuvre; don't... x² Ⅷ ٣ a1 1a naïve— ﬁn ǅ ʰa ñ, ñ",
    "".join(chr(c) + " " + chr(c) + "a, " for c in range(33, 3000) if not 0x300 <= c < 0x370), "e\u0301 E\u0301, \u0130, \u03a3\u03a3 ",
    "same text", "same text", "word " * 6000,
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_whole_texts(path):
    encoder = encoding.Encoder(encoding.read_description(path))
    assert encoder.kind in ("byte", "word")
    plain = Tokenizer.from_file(path)
    want = [encoding.little_endian(plain.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert encoder.encode(TEXTS) == want
    assert encoder.encode(TEXTS[::-1]) == want[::-1]


def test_latin_words_are_lowered_without_the_normalizer():
    """Characters below U+0300 do not combine, so this gives the same ids at a small part of the cost."""
    plain = Tokenizer.from_file(WORD)
    latin = [chr(c) for c in range(33, 0x300) if not chr(c).isspace() and max(chr(c).lower()) < "\u0300"]
    texts = [" ".join(f"x{a}{b}" for b in latin[::7]) for a in latin] + [" ".join(latin)]
    encoder = encoding.Encoder(encoding.read_description(WORD))
    normalize, asked = encoder.normalizer.normalize_str, []

    class Counted:
        def normalize_str(self, text):
            asked.append(text)
            return normalize(text)

    encoder.normalizer = Counted()
    assert encoder.encode(texts) == [encoding.little_endian(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert asked == []
    assert encoder.encode(["e\u0301"]) == [encoding.little_endian(plain.encode("e\u0301", add_special_tokens=False).ids)] and asked


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, doc_id long, part string, ids string")


def rows():
    keys = [None, 5, 3, 3, -7, *range(20, 20 + len(TEXTS) - 5)]
    return [(t, k, "x", "y") for t, k in zip(TEXTS, keys)]


def test_token_files_round_trip(spark):
    folder = new_folder(spark, "test")
    manifest = token_files.write_token_files(frame(spark, rows()).repartition(3), folder, BYTE, 2)
    assert manifest.agg({"docs": "sum"}).first()[0] == len(TEXTS)
    got = token_files.read_token_files(spark, folder).collect()
    plain = Tokenizer.from_file(BYTE)
    want = sorted((-(10**9) if k is None else k, encoding.little_endian([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for t, k, *_ in rows())
    by_start = sorted(got, key=lambda r: r["start"])
    assert sorted((-(10**9) if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got) == want
    ids = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in by_start]
    assert ids == sorted(ids)
    assert [r["start"] for r in by_start] == [0, *np.cumsum([r["n_tokens"] for r in by_start])[:-1]]
    for name, _ in token_files.token_bases(manifest):
        _, _, ends, flat = token_files.open_file(folder, name)
        assert isinstance(flat, np.memmap) and flat.dtype == np.dtype("<u2") and ends[-1] == len(flat)


def test_token_files_of_an_empty_table(spark):
    folder = new_folder(spark, "test")
    assert token_files.write_token_files(frame(spark, []), folder, BYTE, 2).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_packing_places_each_id_once(spark, parts):
    many = [(f"{t} {n}" if t else t, 100 * n + i, "x", "y") for n in range(30) for i, t in enumerate(TEXTS)]
    got = packing.pack(frame(spark, many).repartition(parts), WORD, 1, size=256, open_windows=4).toPandas()
    plain = Tokenizer.from_file(WORD)
    want = sorted((n, encoding.little_endian([*plain.encode(t or "", add_special_tokens=False).ids, 1])) for t, n, *_ in many)
    got["crc"] = got["ids"].map(zlib.crc32)
    assert (got["ids"].map(len) == 4 * got["length"]).all()
    assert got["length"].sum() == sum(len(b) // 4 for _, b in want)
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        assert group["length"].sum() <= 256
    # the documents come back from their pieces
    plain_docs = got[got["doc_tokens"] > 256].sort_values(["doc_id", "start"]).groupby("doc_id")["ids"].apply(b"".join)
    assert list(plain_docs) == [b for _, b in want if len(b) // 4 > 256]
    used = got["sequence_id"].nunique() * 256
    assert got["length"].sum() / used > 0.97


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), WORD, 1).count() == 0
    assert packing.pack(frame(spark, [(None, None, "", ""), ("", 1, "", "")]), WORD, 1).count() == 2
    assert packing.pack(frame(spark, [(None, None, "", ""), ("", 1, "", "")]), WORD, None).count() == 0


def test_open_windows_emit_the_fullest():
    state = packing.OpenWindows(10, 2, least_cut=5)
    add = lambda n: [[p[2] for p in w] for w in state.add(0, memoryview(bytes(4 * n)))]
    assert add(8) == [] and add(6) == []
    assert add(5) == [[8]]  # no room: the fullest goes, its gap is too small for a cut
    assert add(4) == [[6, 4]]  # best fit, not first fit
    assert add(10) == [[10]] and add(23) == [[10], [10]]
