import io
import wave
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import audio as A


def wav(samples, rate=2000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        f.writeframes(samples.astype("<i2").tobytes() if width == 2 else samples)
    return out.getvalue()


def plain_codes(c, samples):
    """The packed integers by direct sums, without integral images."""
    frames = [samples[i : i + c.frame] * np.hanning(c.frame).astype(np.float32) for i in range(0, len(samples) - c.frame + 1, c.hop)]
    image = [(np.abs(np.fft.rfft(f.astype(np.float32))) ** 2) @ A.classes(c) for f in frames]
    image = np.array([x / max(x.sum(), 1e-9) for x in image]).reshape(-1, 12)
    out = []
    for t in range(len(image) - c.width + 1):
        code = 0
        for k, (kind, y, h, w) in enumerate(c.filters()):
            box = image[t : t + w, y : y + h]
            top, left = np.arange(h)[None] < h // 2, np.arange(w)[:, None] < w // 2
            pick = {1: top | (left & False), 2: left | (top & False), 3: top == left, 4: (np.arange(h)[None] // 1 >= h // 3) & (np.arange(h)[None] < h // 3 + max(1, h // 3)) | (left & False), 5: (np.arange(w)[:, None] >= w // 3) & (np.arange(w)[:, None] < w // 3 + max(1, w // 3)) | (top & False)}
            a = box.sum() if kind == 0 else box[pick[kind]].sum()
            b = image[t : t + w, (y + h) % (12 - h) : (y + h) % (12 - h) + h].sum() if kind == 0 else box.sum() - a
            v = np.log1p(a) - np.log1p(b)
            level = int(v > -c.step) + int(v > c.step / 4) + int(v > c.step)
            code |= (level ^ level >> 1) << 2 * k
        out.append(code)
    return out


def test_codes_equal_direct_sums():
    c, rng = A.Chroma(), np.random.default_rng(0)
    recs = [np.rint(rng.normal(0, 5000, n)).astype(np.int16) for n in (5000, 0, 100, 256, 3001)]
    column = pa.array([wav(r) for r in recs] + [None, b"junk"])
    samples, starts = A.wav_samples(column)
    assert np.diff(starts).tolist() == [5000, 0, 100, 256, 3001, 0, 0]
    got, at = A.codes(c, samples, starts)
    for i, r in enumerate(recs):
        want, have = plain_codes(c, r), got[at[i] : at[i + 1]]
        assert len(want) == len(have)
        assert sum(int(x ^ int(y)).bit_count() for x, y in zip(want, have)) <= 1  # rounding next to a threshold


def test_an_excerpt_aligns_with_its_recording(spark):
    c, rng = A.Chroma(), np.random.default_rng(1)
    tones = lambda n, seed: np.concatenate([np.rint(8000 * np.sin(2 * np.pi * f * np.arange(512) / 2000)) for f in 220 * 2 ** (np.random.default_rng(seed).integers(0, 24, n) / 12)]).astype(np.int16)
    song, other = tones(60, 1), tones(60, 2)
    noisy = (song[20 * c.hop :] + rng.normal(0, 20, len(song) - 20 * c.hop)).astype(np.int16)
    rows = [(5, wav(song)), (3, wav(noisy)), (9, wav(song)), (7, wav(other)), (11, None), (12, b""), (None, wav(song))]
    df = spark.createDataFrame(rows, "rec long, media binary").withColumn("codes", F.lit("clash"))
    got = {r["rec_id"]: r for r in A.aligned(A.fingerprints(df, "rec", "media")).collect()}
    assert len(got) == 7 and got[5]["class_id"] == got[9]["class_id"] == got[3]["class_id"] == got[None]["class_id"] == 3
    assert got[5]["partner_id"] == 3 and got[5]["offset"] == 20 and got[5]["bit_error"] < 0.1 and got[5]["votes"] > 3
    assert got[7]["class_id"] == 7 and got[7]["partner_id"] is None and got[11]["class_id"] == 11 and got[12]["n_codes"] == 0
    assert A.aligned(A.fingerprints(df.limit(0), "rec", "media")).count() == 0


def test_classes_equal_all_pairs_on_the_table(spark):
    from barloom.llm.queries import op1_chroma

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    c = A.Chroma()
    samples, starts = A.melody(pa.array([r["text"] for r in turns]))
    values, at = A.codes(c, samples, starts)
    ids = [r["conv_id"] * 1_000_000 + r["turn"] for r in turns]
    part = [values[at[i] : at[i + 1]] for i in range(len(ids))]
    marks = [set(A.landmarks(v, 8, 4)[0].tolist()) for v in part]
    label = dict(zip(ids, ids))
    for _ in range(20):
        for i in range(len(ids)):
            for j in range(i):
                if (len(part[i]) and part[i].tobytes() == part[j].tobytes()) or marks[i] & marks[j]:
                    label[ids[i]] = label[ids[j]] = min(label[ids[i]], label[ids[j]])
    got = {r["rec_id"]: r for r in op1_chroma(spark, "/root/testdata/sf0.001").collect()}
    assert {k: r["class_id"] for k, r in got.items()} == label
    place = {i: k for k, i in enumerate(ids)}
    for k, r in got.items():
        if r["partner_id"] is not None:
            assert abs(A.bit_errors(part[place[k]], part[place[r["partner_id"]]], r["offset"]) - r["bit_error"]) < 1e-9


def song(n=60, seed=1, rate=2000, hop=512):
    t = np.arange(hop * rate // 2000) / rate
    return np.concatenate([np.rint(8000 * np.sin(2 * np.pi * f * t)) for f in 220 * 2 ** (np.random.default_rng(seed).integers(0, 24, n) / 12)]).astype(np.int16)


def float_wav(x, rate):
    body = (x / 32768).astype("<f4").tobytes()
    head = b"fmt " + (16).to_bytes(4, "little") + (3).to_bytes(2, "little") + (1).to_bytes(2, "little") + rate.to_bytes(4, "little") + (4 * rate).to_bytes(4, "little") + (4).to_bytes(2, "little") + (32).to_bytes(2, "little")
    rest = b"WAVE" + head + b"data" + len(body).to_bytes(4, "little") + body
    return b"RIFF" + len(rest).to_bytes(4, "little") + rest


def test_channels_widths_and_rates_give_the_codes_of_the_plain_recording():
    c, mono = A.Chroma(), song()
    wide = np.repeat(mono.astype(np.int32) << 8, 1)
    forms = [
        wav(mono),
        wav(np.stack((mono, mono), axis=1).ravel(), channels=2),
        wav(b"".join(int(x).to_bytes(3, "little", signed=True) for x in wide), width=3),
        wav((mono.astype(np.int64) << 16).astype("<i4").tobytes(), width=4),
        float_wav(mono, 2000),
    ]
    samples, starts = A.wav_samples(pa.array(forms), c)
    assert (np.diff(starts) == len(mono)).all() and all((samples[a:b] == mono).all() for a, b in zip(starts[:-1], starts[1:]))
    want = A.codes(c, mono, np.array([0, len(mono)]))[0]
    other = [wav(song(rate=r), rate=r) for r in (8000, 44100)] + [wav((mono // 256 + 128).astype(np.uint8).tobytes(), width=1)]
    samples, starts = A.wav_samples(pa.array(other), c)
    got, at = A.codes(c, samples, starts)
    for a, b in zip(at[:-1], at[1:]):
        assert abs((b - a) - len(want)) <= 1 and A.bit_errors(got[a:b], want, 0) < 0.05
    broken = [b"RIFF", b"RIFF\x00\x00\x00\x00WAVEfmt ", forms[0][:30], forms[0].replace(b"WAVE", b"AVI "), float_wav(mono, 0)]
    assert len(A.wav_samples(pa.array(broken), c)[0]) == 0


def test_noisy_copies_are_found(spark):
    """Recall of landmarks by the noise's part of the amplitude; no two songs are taken for one."""
    for level, least in ((0.02, 20), (0.05, 20), (0.1, 17)):
        rng = np.random.default_rng(5)
        songs = [song(320, 100 + k, hop=128) for k in range(20)]
        rows = [(k, wav(x)) for k, x in enumerate(songs)] + [(100 + k, wav(np.clip(x + rng.normal(0, 8000 * level, len(x)), -32768, 32767).astype(np.int16))) for k, x in enumerate(songs)]
        got = {r["rec_id"]: r["class_id"] for r in A.aligned(A.fingerprints(spark.createDataFrame(rows, "rec long, media binary"), "rec", "media")).collect()}
        assert sum(got[100 + k] == k for k in range(20)) >= least and all(got[k] == k for k in range(20))


def test_a_landmark_of_most_recordings_and_repeated_ids(spark, monkeypatch):
    rows = [(k, wav(np.concatenate((song(30, 1), song(30, 200 + k))))) for k in range(40)] + [(7, wav(song(60, 999)))] * 2
    df = spark.createDataFrame(rows, "rec long, media binary")
    plain = sorted(map(repr, A.aligned(A.fingerprints(df, "rec", "media")).collect()))
    monkeypatch.setattr(A, "join_hot", partial(A.join_hot, least=5))  # by broadcast
    assert sorted(map(repr, A.aligned(A.fingerprints(df, "rec", "media")).collect())) == plain and len(plain) == 42
