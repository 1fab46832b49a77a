"""Speech engines and the synthesis of whole chapters."""

from __future__ import annotations

import importlib
import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.audio import DEFAULT_VOICES, MAX_GAIN, PAUSE_MS, PEAK, RATE, TONE_CHARS, TONE_MS


class SpeechEngine(Protocol):
    """What an engine offers; one instance serves one task, so it may keep state and load models once."""

    sample_rate: int

    def synthesize(self, text: str) -> np.ndarray:
        """16-bit samples for the text."""


def finish(signal: np.ndarray, rate: int) -> np.ndarray:
    """As ``functions.audio.finish_samples``, for workers."""
    x = np.asarray(signal, np.float32)
    if not len(x):
        return np.zeros(0, np.int16)
    good = np.isfinite(x)
    mean = np.add.accumulate(x[good])[-1] / np.float32(good.sum()) if good.any() else np.float32(0)
    x = np.where(good, x - mean, np.float32(0)).astype(np.float32)
    peak = np.abs(x).max()
    x = x * (min(np.float32(PEAK) / peak, np.float32(MAX_GAIN)) if peak > 0 else np.float32(1))
    fade = min(max(rate, 1) // 100, len(x) // 2)
    if fade:
        ramp = np.arange(fade, dtype=np.float32) / np.float32(fade)
        x[:fade] *= ramp
        x[len(x) - fade :] *= 1 - ramp
    return np.clip(x * np.float32(32767), -32768, 32767).astype(np.int16)


class ToneEngine:
    """A 440 Hz tone whose length follows the text: deterministic, for tests and dry runs.

    There are as many tones as lengths that count, so each is made once and kept.
    """

    def __init__(self, sample_rate: int = RATE):
        self.sample_rate = sample_rate
        self.made: dict[int, np.ndarray] = {}

    def synthesize(self, text: str) -> np.ndarray:
        n = self.sample_rate * TONE_MS * min(max(len(text), 1), TONE_CHARS) // 1000
        if n not in self.made:
            t = np.arange(n, dtype=np.float32) / np.float32(self.sample_rate)
            self.made[n] = finish(np.sin(2 * np.pi * 440 * t).astype(np.float32) * np.float32(0.15), self.sample_rate)
        return self.made[n]


class OnnxEngine:
    """A model file of onnxruntime with inputs tokens or input_ids, style and speed, and output audio or waveform."""

    def __init__(self, model: str, tokens: Callable[[str], list[int]], style: Callable[[int], np.ndarray], speed: float = 1.0, sample_rate: int = RATE):
        import onnxruntime

        if not os.path.isfile(model):
            raise FileNotFoundError(model)
        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        names = {i.name for i in self.session.get_inputs()}
        self.tokens_name = "input_ids" if "input_ids" in names else "tokens"
        self.output = next((o.name for o in self.session.get_outputs() if o.name in ("audio", "waveform")), self.session.get_outputs()[0].name)
        self.tokens, self.style, self.speed, self.sample_rate = tokens, style, speed, sample_rate

    def synthesize(self, text: str) -> np.ndarray:
        ids = self.tokens(text)
        speed = np.array([self.speed], np.int32 if self.tokens_name == "input_ids" else np.float32)
        out = self.session.run([self.output], {self.tokens_name: np.array([[0, *ids, 0]], np.int64), "style": self.style(len(ids)), "speed": speed})[0]
        return finish(np.ravel(out), self.sample_rate)


def style_row(styles: np.ndarray, tokens: int) -> np.ndarray:
    """The style for a text of so many tokens: the last one for longer texts."""
    return styles[min(max(tokens - 1, 0), len(styles) - 1)]


def voice_spec(spec: str | None, generation: str = "v1.0") -> tuple[str, float]:
    """Name and speed as ``functions.audio.parse_voice`` has them, for workers."""
    name, at, after = (spec or "").partition("@")
    name = name.strip().lower().replace("-", "_").replace(" ", "")
    try:
        speed = float(after) if generation == "v1.0" else float(int(after))
    except ValueError:
        speed = 1.0
    return (DEFAULT_VOICES[generation] if name in ("", "auto") else name), speed if at else 1.0


def read_voices(data: bytes) -> dict[str, np.ndarray]:
    """Voice packs from their file: a map of names to lists of rows of 32-bit floats, lengths as varints (below 251 in
    a byte, else 251, 252 or 253 and 2, 4 or 8 bytes). Each pack is an array (rows, 1, values)."""
    at = 0

    def length() -> int:
        nonlocal at
        first = data[at]
        size = {251: 2, 252: 4, 253: 8}.get(first, 0)
        at += 1 + size
        return int.from_bytes(data[at - size : at], "little") if size else first

    packs = {}
    for _ in range(length()):
        n = length()
        name = data[at : at + n].decode()
        at += n
        rows = []
        for _ in range(length()):
            inner = []
            for _ in range(length()):
                n = length()
                inner.append(np.frombuffer(data, "<f4", n, at))
                at += 4 * n
            rows.append(inner)
        packs[name] = np.array(rows, np.float32)
    if at != len(data):
        raise ValueError("the file of voices is longer than its packs")
    return packs


def missing_files(folder: str, names: list[str | tuple[str, ...]]) -> list[str]:
    """Which of the files a model needs aren't there; of several names one is enough."""
    every = [(n,) if isinstance(n, str) else n for n in names]
    return [" or ".join(n) for n in every if not any(os.path.isfile(os.path.join(folder, x)) for x in n)]


def voice_folder(root: str, candidates: tuple[str, ...] = ("voices", "voices-template", "")) -> str:
    """The first folder that holds an index of voices."""
    for c in candidates:
        if os.path.isfile(os.path.join(root, c, "index.json")):
            return os.path.join(root, c).rstrip("/")
    raise FileNotFoundError(f"no index.json under {root}: looked in {', '.join(c or '.' for c in candidates)}")


def onnx_engine(model_dir: str = "./onnx", voice: str | None = None, tokens: Callable[[str], list[int]] | None = None, **options: object) -> OnnxEngine:
    """``OnnxEngine`` from a folder with model.onnx, voices.bin and vocab.json (character to token)."""
    if lacking := missing_files(model_dir, ["model.onnx", "voices.bin", *([] if tokens else ["vocab.json"])]):
        raise FileNotFoundError(f"{model_dir} lacks {', '.join(lacking)}")
    with open(os.path.join(model_dir, "voices.bin"), "rb") as f:
        packs = read_voices(f.read())
    if tokens is None:
        with open(os.path.join(model_dir, "vocab.json"), encoding="utf-8") as f:
            vocabulary = json.load(f)
        tokens = lambda text: [vocabulary[c] for c in text if c in vocabulary]
    engine = OnnxEngine(os.path.join(model_dir, "model.onnx"), tokens, lambda n: style_row(pack, n), **options)
    name, engine.speed = voice_spec(voice, "v1.1" if engine.tokens_name == "input_ids" else "v1.0")
    if name not in packs:
        raise KeyError(f"no voice {name!r}; there are {', '.join(sorted(packs))}")
    pack = packs[name]
    return engine


def codec_engine(model_dir: str = "./codec", voice: str | None = None, runtime: str | None = None, codec: str | None = None, **options: object) -> SpeechEngine:
    """An engine of a language model and a codec: the folder is checked here, the model itself is run by ``runtime``
    (module:function, called with the folder, the folder of voices or None, and the voice), which isn't included."""
    if lacking := missing_files(model_dir, [("model.safetensors", "model.bin"), "config.json", "tokenizer.json", *([codec] if codec else [])]):
        raise FileNotFoundError(f"{model_dir} lacks {', '.join(lacking)}")
    name = voice or "default"
    voices = None if name == "unconditioned" else voice_folder(model_dir)
    if not runtime:
        raise ValueError("name the runtime of this engine as module:function")
    module, _, function = runtime.partition(":")
    return getattr(importlib.import_module(module), function)(model_dir, voices, name, **options)


#: Engines by name; further ones may be registered.
ENGINES: dict[str, Callable[..., SpeechEngine]] = {"tone": ToneEngine, "onnx": onnx_engine, "codec": codec_engine}


def build_engine(name: str, **options: object) -> SpeechEngine:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name](**options)


def engine_options(name: str, model_dir: str | None = None, voice: str | None = None, sample_rate: int | None = None) -> dict[str, object]:
    """What an engine is built with: only what was asked for, and for the tone engine no model or voice."""
    given = {"model_dir": model_dir, "voice": voice} if name != "tone" else {}
    return {k: v for k, v in (given | {"sample_rate": sample_rate}).items() if v is not None}


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAV file."""
    data = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def write_file(path: str, data: bytes) -> None:
    """Write under another name, then rename: a retried or speculative task leaves a whole file or none.

    A path with a scheme other than file is written through that file system (hdfs, s3, gs); one without, or with
    file, must lie on a mount that all executors share.
    """
    scheme, _, rest = path.partition("://")
    if rest and scheme != "file":
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        other = f"{inner}.{uuid.uuid4().hex}.tmp"
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(other) as out:
            out.write(data)
        store.move(other, inner)
        return
    path = rest or path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def chapter_audio(engine: SpeechEngine, chunks: list[str], pause_ms: int = PAUSE_MS) -> np.ndarray:
    """The chunks' samples with pauses between them."""
    pause = np.zeros(engine.sample_rate * pause_ms // 1000, np.int16)
    parts: list[np.ndarray] = []
    for i, chunk in enumerate(chunks):
        if i:
            parts.append(pause)
        parts.append(np.asarray(engine.synthesize(chunk), np.int16))
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def synthesize_chapters(df: DataFrame, keys: list[str], chunks: str = "chunks", path: str | None = None, engine: str = "tone", pause_ms: int = PAUSE_MS, keep_audio: bool = False, record: tuple[str, str] | None = None, **options: object) -> DataFrame:
    """One result per chapter: ``keys``, output, n_samples, sample_rate, status, error and, if kept, the samples.

    An engine is built once per task. A chapter that fails gets status error and the message, and the others go
    on. With ``path`` (a column) a WAV file is written there by the worker, so the folder must be shared; with ``record``
    (columns of a path and its content) that is written once the sound file is whole, not if the chapter fails. Null
    chunks count as none: a chapter without text is an empty file.
    """
    schema = df.select(*keys).schema.add("output", "string").add("n_samples", "long").add("sample_rate", "integer").add("status", "string").add("error", "string").add("pcm", "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voice = build_engine(engine, **options)
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                own = [r[k] for k in keys]
                try:
                    samples = chapter_audio(voice, list(r["_chunks"]) if r["_chunks"] is not None else [], pause_ms)
                    if r["_path"]:
                        write_file(r["_path"], wav_bytes(samples, voice.sample_rate))
                        if r["_record"]:
                            write_file(r["_record"], r["_content"].encode())
                    rows.append([*own, r["_path"], len(samples), voice.sample_rate, "done", None, samples.tobytes() if keep_audio else None])
                except Exception as e:
                    rows.append([*own, None, 0, voice.sample_rate, "error", f"{type(e).__name__}: {e}", None])
            yield pd.DataFrame(rows, columns=schema.names)

    from pyspark.sql import functions as F

    target = F.col(path) if path else F.lit(None).cast("string")
    noted = [F.col(c) for c in record] if record else [F.lit(None).cast("string")] * 2
    out = df.select(*keys, F.col(chunks).alias("_chunks"), target.alias("_path"), noted[0].alias("_record"), noted[1].alias("_content")).mapInPandas(run, schema)
    return out if keep_audio else out.drop("pcm")
