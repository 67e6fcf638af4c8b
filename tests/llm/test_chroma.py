import numpy as np
import pytest

from lodestore.llm import chroma


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    return chroma.read_wav(chroma.sonify(list(rng.normal(0, 0.13, notes))))


def prints(samples):
    return chroma.pack(chroma.frames(samples))


@pytest.mark.parametrize("hops", [0, 5, 40])
def test_offsets_are_found_under_noise(hops):
    whole = tune(1)
    part = whole[hops * chroma.HOP :] + 0.05 * np.random.default_rng(2).standard_normal(len(whole) - hops * chroma.HOP)
    offset, errors = chroma.align(prints(whole), prints(part))
    assert offset == hops and errors < 0.05


def test_strangers_do_not_align():
    assert min(chroma.align(prints(tune(3)), prints(tune(k)))[1] for k in range(4, 14)) > 0.25


def test_wav_forms():
    x = np.sin(np.arange(8000) / 10)
    stereo = np.repeat((x * 32767).astype("<i2"), 2).tobytes()
    raw = chroma.write_wav(x)
    two = raw[:22] + b"\x02\x00" + raw[24:40] + len(stereo).to_bytes(4, "little") + stereo
    assert np.allclose(chroma.read_wav(raw), chroma.read_wav(two), atol=1e-4)
    assert chroma.read_wav(None) is None and chroma.read_wav(b"") is None and chroma.read_wav(b"RIFFxxxxWAVE") is None
    assert len(prints(np.zeros(100))) == 0 and len(set(prints(np.zeros(9000)).tolist())) == 1


def test_search_against_brute_force(spark):
    tunes = {i: tune(i) for i in range(90, 110)}
    tunes[205] = tunes[100][20 * chroma.HOP :] + 0.02 * np.random.default_rng(5).standard_normal(len(tunes[100]) - 20 * chroma.HOP)
    tunes[300] = tunes[100]
    media = spark.createDataFrame([(i, bytearray(chroma.write_wav(x)), "clash") for i, x in tunes.items()] + [(7, None, ""), (8, bytearray(b"?"), ""), (None, bytearray(chroma.write_wav(tunes[91])), "")], "id long, media binary, items string")
    found = chroma.fingerprint(media, "id", "media")
    got = {r["id"]: r for r in chroma.search(found).collect()}
    assert set(got) == set(tunes) and got[300]["class_id"] == 100
    own = {i: prints(chroma.read_wav(chroma.write_wav(x))) for i, x in tunes.items()}
    for i, r in got.items():
        offset, errors = chroma.align(own[i], own[100])
        expected = own[i].tolist() != own[100].tolist() and errors <= chroma.ERRORS
        assert (r["n_matches"] > 0) == expected
        if expected:
            assert (r["match_class"], r["match_offset"]) == (100, offset) and np.isclose(r["match_errors"], errors)
    assert got[205]["match_offset"] == -20
    assert chroma.search(found.filter("id < 0")).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, []), (4, [float("nan")] * 64), (None, [0.2] * 64)], "vec_id long, embedding array<float>")
    got = {r["id"]: r for r in chroma.of_vectors(rows).collect()}
    assert got[2]["items"] is None and got[3]["items"] is None and got[4]["edit_offset"] is not None and len(got[1]["items"]) == 170


def recalled(spark, prints_of):
    """Pairs that ``search`` matches, and those of brute force: 3 votes at an offset, bit errors by ``align``."""
    found = spark.createDataFrame([(i, x.astype(np.int64).tolist()) for i, x in prints_of.items()], "id long, items array<long>")
    got = {(r["id"], r["match_class"], r["match_offset"], round(r["match_errors"], 9)) for r in chroma.search(found).filter("n_matches > 0").collect()}
    expected = set()
    for i, a in prints_of.items():
        fits = []
        for q, b in prints_of.items():
            votes = {}
            for x, y in zip(*np.nonzero(a[:, None] == b[None, :]), strict=True):
                votes[x - y] = votes.get(x - y, 0) + 1
            offset, errors = chroma.align(a, b)
            if q % 100 == 0 and q != i and max(votes.values(), default=0) >= chroma.VOTES and errors <= chroma.ERRORS:
                fits.append((errors, q, offset))
        expected |= {(i, q, o, round(e, 9)) for e, q, o in sorted(fits)[:1]}
    return got, expected


def test_search_of_noisy_recordings(spark):
    """No three places where two successive integers are both equal, yet enough equal ones."""
    base, rng = {100 * k: prints(tune(k)) for k in range(1, 4)}, np.random.default_rng(8)
    noisy = {}
    for k in range(1, 4):
        for j in range(8):
            x = base[100 * k][5 * j :].copy()
            x[rng.random(len(x)) < 0.15 + 0.1 * j] ^= np.uint32(1 << int(rng.integers(32)))
            x[:: 2 if j % 2 else 3] ^= np.uint32(5)
            noisy[100 * k + 1 + j] = x
    got, expected = recalled(spark, base | noisy)
    assert len(expected) >= 20 and got == expected


def test_search_of_short_held_and_repeated_recordings(spark):
    """Three integers; silence; and a pair whose offset of most votes is not the one of least bit errors."""
    rng = np.random.default_rng(9)
    short, far = rng.integers(0, 2**32, 3, dtype=np.uint32), rng.integers(0, 2**32, 40, dtype=np.uint32)
    near = far ^ np.uint32(1)
    near[[3, 11, 19, 27]] = far[[3, 11, 19, 27]]
    near[[6, 8, 10, 12, 14]] = far[[1, 3, 5, 7, 9]]
    held = np.repeat(rng.integers(0, 2**32, 3, dtype=np.uint32), (400, 3, 300))
    got, expected = recalled(spark, {100: short, 101: np.append(short, np.uint32(7)), 200: far, 201: near, 300: held, 301: held[50:]})
    assert {i for i, *_ in expected} >= {101, 201, 301} and got == expected


@pytest.mark.xfail(strict=True, reason="open: 33 of 40; under the loudest noise 7 of 8 recordings have fewer than VOTES equal integers at an offset")
def test_recall_against_bit_errors_alone(spark):
    """Recordings cut and played over noise: of the pairs with few bit errors at any offset that half of the shorter one
    meets, whether or not any integers are equal, at least 0.9 are found."""
    tunes, rng = {100 * k: tune(k) for k in range(1, 9)}, np.random.default_rng(12)
    played = dict(tunes)
    for k in range(1, 9):
        for j, noise in enumerate((0.02, 0.05, 0.1, 0.2, 0.4)):
            cut = tunes[100 * k][(7 * j + k) * chroma.HOP :]
            played[100 * k + 1 + j] = cut + noise * rng.standard_normal(len(cut))
    items = {i: prints(x) for i, x in played.items()}
    expected = set()
    for i, a in items.items():
        for q in tunes:
            b = items[q]
            half = min(len(a), len(b)) // 2
            fits = [chroma.bit_errors(a, b, o) for o in range(1 - len(b), len(a))]
            if i != q and min((e for e, n in fits if n >= half), default=1.0) <= chroma.ERRORS:
                expected.add((i, q))
    found = spark.createDataFrame([(i, x.astype(np.int64).tolist()) for i, x in items.items()], "id long, items array<long>")
    got = {(r["id"], r["match_class"]) for r in chroma.search(found).filter("n_matches > 0").collect()}
    assert len(expected) >= 20 and len(got & expected) >= 0.9 * len(expected)
