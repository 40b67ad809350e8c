import io
import wave

import numpy as np

from meterlake.llm.media import FRAME, HOP, from_wav, landmarks, media_documents, padded, to_wav

from .samples import HARD, docs


def test_padding():
    assert len(padded(b"")) == FRAME and padded(b"x" * FRAME) == b"x" * FRAME and len(padded(b"x" * (FRAME + 1))) == 2 * FRAME
    assert padded(b"ab")[2:] == b"\xff" * (FRAME - 2)


def test_round_trip(spark):
    for r in media_documents(docs(spark, extra=True)).collect():
        raw = (HARD[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload == padded(raw) and from_wav(r.media) == r.payload
        with wave.open(io.BytesIO(r.media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, len(r.payload))
        assert len(r.times) == len(r.codes) > 0 and r.times == sorted(r.times)


def test_peaks_of_a_tone():
    t = np.arange(FRAME * 10)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / FRAME)).astype(np.uint8).tobytes()
    times, codes = landmarks(tone)
    assert {40} <= {int(c) >> 12 for c in codes} and not {39, 41} & {int(c) >> 12 for c in codes} and to_wav(tone)[:4] == b"RIFF"


def test_blocks_do_not_change_the_result():
    data = np.random.default_rng(1).integers(0, 256, FRAME * 50).astype(np.uint8).tobytes()
    a, b = landmarks(data, rows=7), landmarks(data)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def plain_peaks(data):
    """The two strongest bins of each frame that are larger than those beside them, by sums over cosines and sines."""
    x = np.frombuffer(data, np.uint8).astype(float)
    t, k = np.arange(FRAME), np.arange(FRAME // 2 + 1)[:, None]
    wave_ = np.exp(-2j * np.pi * k * t / FRAME)
    out = []
    for at in range(0, len(x) - FRAME + 1, HOP):
        f = x[at : at + FRAME]
        power = [0, *np.round(np.abs(wave_ @ ((f - f.mean()) * np.hanning(FRAME))), 2)[1:], -1]
        found = [b for b in range(1, FRAME // 2 + 1) if power[b - 1] < power[b] >= power[b + 1]]
        out.append(sorted(found, key=lambda b: (-power[b], b))[:2])
    return out


def test_landmarks_as_by_plain_sums():
    rng = np.random.default_rng(9)
    t = np.arange(FRAME * 6)
    for tones in ((31, 77), (12, 200), (64, 65)):
        data = 128 + sum(40 * np.sin(2 * np.pi * f * t / FRAME + i) for i, f in enumerate(tones)) + rng.normal(0, 1, len(t))
        data = np.clip(data, 0, 255).astype(np.uint8).tobytes()
        peaks, want = plain_peaks(data), set()
        assert all(abs(p[0] - p[1]) > 1 for p in peaks)
        for i, own in enumerate(peaks):
            want |= {(i, a << 12 | b << 3 | gap) for gap in (1, 2) if i + gap < len(peaks) for a in own for b in peaks[i + gap]}
        assert set(zip(*map(np.ndarray.tolist, landmarks(data)), strict=True)) == want


def test_frames_without_peaks():
    silence = bytes([128]) * (FRAME * 3)
    assert [x.tolist() for x in landmarks(silence)] == [[0], [0]]
    t = np.arange(FRAME)
    tone = np.clip(128 + 100 * np.sin(2 * np.pi * 40 * t / FRAME), 0, 255).astype(np.uint8).tobytes()
    times, codes = landmarks(tone)  # one frame: no pairs
    assert set(times.tolist()) == {0} and 40 << 12 in codes.tolist()
    times, codes = landmarks(silence + tone + silence)
    assert len(codes) and all(c & 7 for c in codes.tolist()) and 40 in {c >> 12 for c in codes.tolist()}


def test_a_text_of_a_million_characters(spark):
    text = "a rather long text. " * 50_000
    r = media_documents(docs(spark, [text])).first()
    assert r.payload == padded(text.encode()) and len(r.codes) > 5000


def test_empty_table_null_ids_and_repeats(spark):
    assert media_documents(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (2, None), (2, "")], "doc_id long, text string")
    got = media_documents(rows).collect()
    assert len(got) == 4 and len({r.media for r in got}) == 2
