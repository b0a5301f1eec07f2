import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from halyard.llm.packing import Packer, default_path, encoder, pack_documents

from .conftest import words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def check(docs, out, library, size):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    expected = Counter()
    for doc, copies in texts.items():
        for ids in copies:
            expected[doc] += len(ids)
    got, rows = Counter(), out.collect()
    for r in rows:
        got[r["doc_id"]] += r["length"]
        assert any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["doc_tokens"] for ids in texts[r["doc_id"]])
    assert got == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    return len(sequences), sum(expected.values())


def test_awkward_documents(awkward, empty, library):
    check(awkward, pack_documents(awkward), library, 2048)
    assert pack_documents(empty).count() == 0


def test_little_padding_over_many_partitions_and_rounds(make, library):
    docs = make([(i, " ".join(words(20 + i * 7 % 200, i)), "a") for i in range(300)]).repartition(9)
    n, tokens = check(docs, pack_documents(docs, size=256, open_windows=4, fan_in=2), library, 256)
    assert tokens / (256 * n) > 0.98


def test_words_are_encoded_as_in_the_whole_text(library):
    texts = ["The naïve Œuvre, ΣΑΣ İx", "a\tb\x85c  d\n\n", "don't I'll 3.14", "<|ENDOFTEXT|><|endoftext|>a", "①½² ªº. #$%.."]
    for t in texts:
        assert np.frombuffer(encoder(default_path()).encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_long_words_are_not_kept_and_long_texts_are_cut_once(make, library):
    """Texts without spaces leave nothing behind in a worker; a long document costs its length."""
    encode = encoder(default_path())
    texts = ["".join(chr(0x4E00 + (i * 7 + k * 13) % 900) for i in range(3000)) for k in range(20)]
    for t in texts:
        assert np.frombuffer(encode.encode(t + " and more"), "<u4").tolist() == library.encode(t + " and more", add_special_tokens=False).ids
    assert max(map(len, encode.known)) <= 48
    packer, ids = Packer(2048, 4, 16), bytes(4 * 8_000_000)
    began = time.time()
    n = sum(len(window[0][2]) // 4 for window in packer.put((1, 0, ids, 8_000_000)))
    assert time.time() - began < 5 and n + sum(len(p[2]) // 4 for w in packer.leftovers() for p in w) == 8_000_000


def test_another_vocabulary_is_encoded_by_its_library(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(default_path())
    other.normalizer = normalizers.Sequence([])
    other.save(str(tmp_path / "other.json"))
    e = encoder(str(tmp_path / "other.json"))
    assert not e.by_word and np.frombuffer(e.encode("Two WORDS\nhere"), "<u4").tolist() == other.encode("Two WORDS\nhere", add_special_tokens=False).ids
