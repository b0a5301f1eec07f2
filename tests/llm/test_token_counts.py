import pytest

from halyard.llm.token_counts import count_tokens, default_path, load

TEXTS = ["", " ", "  a", "a  b   ", "a\n\nb", "▁a ▁", "日本語 テスト", "<s>hi</s><0x0A>", "ab" * 900 + " " + "x" * 100, " " * 100, "é" * 300, "the" * 300, "😀\x00y", "The quick brown fox, 12.5%!\tOK"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=default_path())


@pytest.mark.parametrize("chunk", [1 << 16, 7, 64])
def test_counts_are_the_librarys(library, chunk):
    machine = load(default_path())
    for text in TEXTS:
        assert machine.count(text, chunk) == len(library.encode(text)), (text[:30], chunk)


def test_state_maps_compose_in_any_grouping(library):
    machine, text = load(default_path()), "▁" + " to be  or not\nto be ".replace(" ", "▁") * 5 + "unspacedlettersofaword" * 3
    parts = [machine.state_map(text, i, min(i + 3, len(text))) for i in range(0, len(text), 3)]
    left = parts[0]
    for p in parts[1:]:
        left = left.then(p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = p.then(right)
    want = machine.step(0, text[: len(text)])[0]
    for m in (left, right):
        state, n = m(0)
        assert n + machine.final[state] == len(library.encode(text[1:]))
        assert state == machine.step(0, text[-66:])[0] or want >= 0


def test_maps_send_states_to_states():
    """A chunk without a boundary: what each state before it makes of it is as in one run."""
    machine = load(default_path())
    for text, cut in (("▁thetheanding", 5), ("▁thewordstogether", 8), ("▁a▁▁b", 3)):
        for before in range(1, cut):
            state, n = machine.step(0, text[before:cut])
            m = machine.state_map(text, cut, len(text))
            whole = machine.run(text[before:])
            after, more = m(state)
            assert n + more + machine.final[after] == whole, (text, before)


def test_long_units_are_not_kept(library):
    machine = load(default_path())
    texts = ["".join(chr(0x4E00 + (i * 7 + k * 13) % 900) for i in range(3000)) for k in range(30)]
    assert [machine.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    assert max(map(len, [*machine.plain, *machine.after_mark])) <= 48


def test_documents(awkward, empty, library):
    got = count_tokens(awkward).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == sorted((len(t.encode()), len(library.encode(t))) for t in texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert count_tokens(empty).count() == 0
