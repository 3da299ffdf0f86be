"""PCM WAV files as waveforms: (file_id, path, sr, samples), mono at one rate.

Files are found and read by Spark, so any storage that it reads will do. Other codecs need a decoder
registered by suffix. Resampling cuts or pads the spectrum.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.dsp import fourier_resample
from voxloom.functions.expressions import suffix

#: Suffixes that count as audio.
SUFFIXES = (".wav", ".flac", ".mp3", ".ogg")
Decoder = Callable[[bytes], tuple[np.ndarray, int]]
WAVE = "path string, sr int, samples array<float>, success boolean, error string"


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Channels x samples between -1 and 1, and the rate, of 8 to 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, sr = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (np.concatenate([np.zeros((len(b), 1), np.uint8), b], axis=1).view("<i4").ravel() >> 8) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).T, sr


_DECODERS: dict[str, Decoder] = {".wav": decode_wav}


def register_decoder(ending: str, decoder: Decoder) -> None:
    _DECODERS[ending.lower()] = decoder


def as_mono(content: bytes, ending: str, rate: int) -> np.ndarray:
    if ending not in _DECODERS:
        raise ValueError(f"no decoder for {ending or 'files without suffix'}")
    x, sr = _DECODERS[ending](content)
    mono = x.mean(axis=0)
    n = int(round(len(mono) * rate / sr))
    return (mono if sr == rate else fourier_resample(mono, n)).astype(np.float32)


def find_audio(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files below ``paths`` (folders or patterns) whose suffix counts, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.filter(suffix(F.col("path")).isin(list(suffixes))).select("path", "length", "modificationTime")


def read_audio(spark: SparkSession, paths: str | list[str], rate: int = 16_000, *, fail: bool = False) -> DataFrame:
    """Waveforms with ``file_id``, the 64-bit hash of the path; a file that cannot be read is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    files = files.filter(suffix(F.col("path")).isin(list(SUFFIXES))).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    ending = "." + path.rsplit(".", 1)[-1].lower()
                    row = (path, rate, as_mono(content, ending, rate), True, None)
                except Exception as e:
                    if fail:
                        raise
                    row = (path, rate, None, False, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "sr", "samples", "success", "error"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # whole files
    return files.mapInPandas(run, WAVE).select(F.xxhash64("path").alias("file_id"), "*")
