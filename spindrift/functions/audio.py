"""Audio in batches: decoding, header probes, resampling, speech ratio and SNR proxy. Runs on the executors."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TARGET_RATE

Segments = list[dict]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and rate of a PCM WAV file; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def probe(data: bytes) -> tuple[float, int]:
    """Duration in seconds and rate, from the header."""
    with wave.open(io.BytesIO(data)) as w:
        return w.getnframes() / w.getframerate(), w.getframerate()


def encode(x: np.ndarray, rate: int = TARGET_RATE) -> bytes:
    """PCM16 WAV; samples beyond [-1, 1] are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(x, -1.0, 1.0) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited, through the spectrum."""
    if rate == target or not len(x):
        return x
    n = max(1, round(len(x) * target / rate))
    spectrum = np.fft.rfft(x)
    kept = np.zeros(n // 2 + 1, complex)
    m = min(len(kept), len(spectrum))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * (n / len(x))


def cut(x: np.ndarray, rate: int, start_s: float | None, end_s: float | None) -> np.ndarray:
    a = 0 if start_s is None else round(start_s * rate)
    b = len(x) if end_s is None else round(end_s * rate)
    if a < 0 or b > len(x) or a >= b:
        raise ValueError(f"[{start_s}, {end_s}] s lies outside {len(x) / rate:.3f} s")
    return x[a:b]


def normalise(data: bytes, start_s: float | None = None, end_s: float | None = None) -> tuple[bytes, float, int, int]:
    """A slice as 16 kHz mono PCM16; its duration, original rate and number of samples."""
    x, rate = decode(data)
    x = resample(cut(x, rate, start_s, end_s), rate, TARGET_RATE)
    return encode(x), len(x) / TARGET_RATE, rate, len(x)


def change_speed(x: np.ndarray, rate: int, factor: float) -> np.ndarray:
    return x if factor == 1.0 else resample(x, int(rate * factor), rate)


def speech_ratio(segments: Segments, n: int) -> float:
    """Share of samples in segments; overlaps count twice."""
    return sum(s["end"] - s["start"] for s in segments) / n if n else 0.0


def snr_proxy_db(x: np.ndarray, segments: Segments) -> float:
    """Mean power in speech over that outside, in dB. No speech: -inf (first); no rest, or a silent one: +inf."""
    inside = np.zeros(len(x), bool)
    for s in segments:
        inside[s["start"] : s["end"]] = True
    power = [float(np.mean(part**2)) if len(part) else None for part in (x[inside], x[~inside])]
    if power[0] is None:
        return -math.inf
    if not power[1]:
        return math.inf
    return 10 * math.log10(power[0] / power[1]) if power[0] else -math.inf


def energy_segments(x: np.ndarray, rate: int, frame_s: float = 0.03, level: float = 0.1) -> Segments:
    """A plain detector: runs of frames with at least `level` of the loudest frame's amplitude."""
    size = max(1, int(rate * frame_s))
    n = len(x) // size
    if not n:
        return []
    rms = np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(1))
    loud = rms >= level * rms.max() if rms.max() > 0 else np.zeros(n, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    return [{"start": int(a) * size, "end": int(b) * size} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def signal_measure(load: Callable[[pd.Series], list[tuple[np.ndarray, int]]], vad: Callable[[np.ndarray, int], Segments]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A measure for the quality cascade: load gives the samples of a batch's clips, vad their speech."""

    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, rate in load(batch["clip_id"]):
            segments = vad(x, rate)
            rows.append((speech_ratio(segments, len(x)), snr_proxy_db(x, segments)))
        return pd.DataFrame(rows, columns=["vad_speech_ratio", "snr_proxy_db"])

    return measure


def speech_ratio_expr(segments: Column, n: Column) -> Column:
    """speech_ratio over array<struct<start, end>>."""
    total = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + s["end"].cast("long") - s["start"].cast("long"))
    return F.when(n > 0, total / n).otherwise(0.0)


def snr_proxy_expr(samples: Column, segments: Column) -> Column:
    """snr_proxy_db over array<double> and array<struct<start, end>>."""
    flagged = F.transform(samples, lambda x, i: F.struct((x * x).alias("p"), F.exists(segments, lambda s: (i >= s["start"]) & (i < s["end"])).alias("speech")))
    mean = lambda keep: F.aggregate(
        F.filter(flagged, keep), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, f: F.struct((a["s"] + f["p"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"])
    )
    speech, noise = mean(lambda f: f["speech"]), mean(lambda f: ~f["speech"])
    inf = F.lit(float("inf"))
    return F.when(speech.isNull(), -inf).when(noise.isNull() | (noise == 0), inf).when(speech == 0, -inf).otherwise(10 * F.log10(speech / noise))
