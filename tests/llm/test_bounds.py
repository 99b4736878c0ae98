"""Memory and recovery: runs over many batches, very long texts, missing parts."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from test_text_ops import _fingerprint

from tidemark.llm import bpe, line_dedup, simhash


def _batches(rows, size):
    for at in range(0, len(rows), size):
        own = list(zip(*rows[at : at + size], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, line_dedup._KEY_ROWS, strict=True)], schema=line_dedup._KEY_ROWS)


def _decided(tasks, size, min_docs=5):
    """What the rows of all tasks, put together as the query does it, lose: (hi, lo, id, mark)."""
    out = [r for t in tasks for b in line_dedup._stream_runs(min_docs)(_batches(t, size)) for r in b.to_pylist()]
    ends, gone = {}, {(r["hi"], r["lo"], r["id"], r["mark"]) for r in out if not r["edge"]}
    for r in out:
        if r["edge"]:
            n, top = ends.get((r["hi"], r["lo"]), (0, r["id"]))
            ends[r["hi"], r["lo"]] = (n + r["fresh"], max(top, r["id"]))
    for r in out:
        if r["edge"] and r["n_lines"]:
            n, top = ends[r["hi"], r["lo"]]
            if n >= min_docs and r["id"] != top:
                gone.add((r["hi"], r["lo"], r["id"], r["mark"]))
    return gone


@pytest.mark.parametrize("held", [3, 10_000])
def test_runs_in_any_batches_and_tasks(monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_ROWS", held)
    rng = random.Random(3)
    for _ in range(60):
        rows = sorted(((i, rng.randint(0, 2), hi, lo, 3, [0]) for hi in range(3) for lo in range(2) for i in rng.choices(range(12), k=rng.choice((1, 3, 6, 30)))), key=lambda r: (r[2], r[3], -r[0], r[1]))
        docs = {}
        for r in rows:
            docs.setdefault((r[2], r[3]), set()).add(r[0])
        want = {(r[2], r[3], r[0], r[1]) for r in rows if len(own := docs[r[2], r[3]]) >= 5 and r[0] != max(own)}
        # A task begins at a new (hash, id): equal keys lie in one range.
        cuts = [0, *sorted(k for k in rng.sample(range(len(rows)), min(3, len(rows))) if k and (rows[k][2], rows[k][3], rows[k][0]) != (rows[k - 1][2], rows[k - 1][3], rows[k - 1][0])), len(rows)]
        tasks = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        assert _decided(tasks, rng.choice((1, 2, 5, 100))) == want


def test_a_run_is_not_held():
    """One run over many batches: rows come out as they go in."""
    run, seen = line_dedup._stream_runs(5), [0]

    def given():
        for b in _batches([(1000 - i // 2, 0, 1, 1, 2, [0]) for i in range(2000)], 10):
            seen[0] += 1
            yield b

    for begun in (False, True):
        seen[0], out = 0, []
        first = _batches([(7, 0, 0, 0, 1, [0])], 1)
        for b in run(x for part in (([] if begun else first), given()) for x in part):
            out.append((seen[0], b.num_rows))
        assert out[2][0] <= 5 and sum(n for _, n in out) <= 1005


def test_long_texts_have_the_fingerprint_of_the_whole():
    rng = random.Random(1)
    text = " ".join(rng.choice(["A", "bb", "ccc\n", "dddd\t", "é"]) for _ in range(3000)).encode()
    for own in (text, text + b" ", b" " + text, b"a b c d", b"a b", b"x" * 500, b" " * 500, b"a " * 2 + b"y" * 300):
        for chunk in (1, 7, 100, 10_000_000):
            assert int(simhash.fingerprints([own], chunk)[0]) == _fingerprint(own.decode())


def test_a_text_of_20_mb_takes_little_memory():
    text = np.random.default_rng(5).integers(97, 123, 20_000_000, dtype=np.uint8)
    text[::6] = 32
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    simhash.fingerprints([text.tobytes()])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


def test_long_pieces_are_not_memoised():
    known = bpe.vocabulary(*bpe.default_tokenizer())
    known.encode("x" * 100_000)
    assert max(map(len, known.pieces), default=0) <= known.pieces.LONGEST


def test_popcount_bound_and_steps():
    """Counts of bits within 4 of each other lie at most one step of 5 apart, and the Manhattan distance is a lower bound."""
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        vectors = [[(v >> s & ((1 << w) - 1)).bit_count() for s, w in zip(simhash.STARTS, simhash.WIDTHS, strict=True)] for v in (x, y)]
        assert sum(abs(a - b) for a, b in zip(*vectors, strict=True)) <= (x ^ y).bit_count()
        for c in simhash.CHOICES:
            rest = simhash._other_bits(c) & (2**64 - 1)
            assert abs((x & rest).bit_count() // 5 - (y & rest).bit_count() // 5) <= 1
