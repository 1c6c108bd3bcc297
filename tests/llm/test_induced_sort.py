"""The suffix sorter against plain sorting, at several memory allowances and depths."""

import os
import tracemalloc

import numpy as np
import pytest

from specloom.llm import induced_sort as s


def plain(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lengths = [0]
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        lengths.append(n)
    return order, lengths


@pytest.mark.parametrize("memory", [1 << 20, 40, 3])
@pytest.mark.parametrize("alphabet", [1, 2, 4, 30, 240])
def test_order_and_lengths(tmp_path, memory, alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 10, 60, 300):
        body = rng.integers(2, 2 + alphabet, n)
        if n > 50:
            body[n // 2 :] = body[: n - n // 2]
        text = np.append(body, 0).astype(np.uint32 if n % 2 else np.uint8)
        got = list(s.induced_sort(text, 240 if n <= 240 else 200, memory, str(tmp_path)))
        order, lengths = np.concatenate([p for p, _ in got]).tolist(), np.concatenate([x for _, x in got]).tolist()
        want, want_lengths = plain(text.tolist())
        if n <= 200:
            assert order == want
        assert [min(x, 200) for x in lengths] == [min(x, 200) for x in want_lengths]
        assert not os.listdir(tmp_path)


@pytest.mark.parametrize("memory", [1 << 20, 20])
def test_limited_depth_groups_equal_prefixes(tmp_path, memory):
    rng = np.random.default_rng(5)
    for depth in (3, 7, 20):
        part = rng.integers(2, 4, 40)
        text = np.concatenate([np.tile(part, 5), [1], rng.integers(2, 4, 300), [1], np.tile(part, 3), [9] * 90, [0]]).astype(np.uint8)
        got = list(s.induced_sort(text, depth, memory, str(tmp_path)))
        order, lengths = np.concatenate([p for p, _ in got]), np.concatenate([x for _, x in got])
        heads = [tuple(text[i : i + depth].tolist()) for i in order]
        assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(text)))
        for a, b, n in zip(heads, heads[1:], lengths[1:], strict=False):
            assert (n >= depth) == (a == b and len(a) == depth)


def a_text(n, seed=3):
    """Words of a small vocabulary, some passages twice: bytes, closed by 0."""
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(2000)]
    body = b" ".join(words[i] for i in np.minimum(1999, rng.zipf(1.3, n // 4)))[:n]
    body = body + body[: n // 5]
    return np.frombuffer(body + b"\0", np.uint8)


def test_memory_does_not_grow_with_the_text(tmp_path, monkeypatch):
    """Texts of 20 and 40 allowances: recursion on disk, the right order, and a peak that the allowance bounds."""
    depths = []
    inner = s._induced
    monkeypatch.setattr(s, "_induced", lambda text, depth, allowance: depths.append(len(text)) or inner(text, depth, allowance))
    allowance, peaks = 3_000, []
    for times in (20, 40):
        plain_text = a_text(allowance * times)
        np.save(tmp_path / "text.npy", plain_text)
        text = np.load(tmp_path / "text.npy", mmap_mode="r")
        size = len(text)
        assert size > allowance * times
        got = np.memmap(tmp_path / "order", np.int64, "w+", shape=(size,))
        depths.clear()
        tracemalloc.start()
        at = 0
        for positions, lengths in s.induced_sort(text, 100, allowance, str(tmp_path)):
            got[at : at + len(positions)] = positions
            at += len(positions)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert at == size and len(depths) >= 2 and depths[1] > allowance
        raw = plain_text.tobytes()
        order = np.array(got)
        assert np.array_equal(np.sort(order), np.arange(size))
        for i in np.random.default_rng(0).integers(1, size, 3000).tolist():
            a, b = int(order[i - 1]), int(order[i])
            assert raw[a : a + 100] <= raw[b : b + 100]
        os.remove(tmp_path / "order")
        os.remove(tmp_path / "text.npy")
        assert not os.listdir(tmp_path)
    assert max(peaks) < allowance * 600 and peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("seed", range(3))
def test_common_prefixes_and_range_minima_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    for dtype, n in ((np.uint8, 5), (np.uint8, 400), (np.uint32, 400)):
        text = np.append(np.tile(rng.integers(1, 3, 1 + n // 5), 5)[: n - 1], 0).astype(dtype)
        a, b = rng.integers(0, n, (2, 300))
        for depth in (1, 7, 100):
            want = [next((i for i in range(depth) if max(x, y) + i >= n or text[x + i] != text[y + i]), depth) for x, y in zip(a, b, strict=True)]
            assert s.common_prefix(text, a, b, depth).tolist() == want
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        assert s._range_min(text, lo, hi).tolist() == [text[x : y + 1].min() for x, y in zip(lo, hi, strict=True)]


def test_a_long_common_prefix_takes_a_step_for_eight_bytes():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            Counted.read += 1
            return super().__getitem__(at)

    text = np.append(np.ones(1000, np.uint8), np.uint8(0)).view(Counted)
    assert s.common_prefix(text, np.array([0, 5]), np.array([100, 300]), 100).tolist() == [100, 100]
    assert Counted.read < 30
