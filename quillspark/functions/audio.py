"""Samples, durations and voice names as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import bound

#: Bytes before the samples of a WAV file.
HEADER = 44
RATE = 24_000
PAUSE_MS = 150
#: Loudest sample after finishing, and the most that quiet signals are raised.
PEAK, MAX_GAIN = 0.98, 3.0
#: The tone engine: milliseconds per character and the characters that count.
TONE_MS, TONE_CHARS = 20, 200
# The voice taken when none is named, by model generation.
DEFAULT_VOICES = {"v1.0": "zf_xiaoxiao", "v1.1": "zf_048"}
# The speed of the fast preset, by model generation.
FAST = {"v1.0": 1.2, "v1.1": 2.0}


def silence(rate: int, ms: int) -> Column:
    """Zeros for so many milliseconds, rounded down."""
    return F.array_repeat(F.lit(0).cast("smallint"), rate * ms // 1000)


def tone_samples(chars: Column, rate: int = RATE) -> Column:
    """Samples that the tone engine makes for a text of so many characters."""
    return F.floor(F.lit(rate * TONE_MS) * F.least(F.greatest(chars, F.lit(1)), F.lit(TONE_CHARS)) / 1000).cast("bigint")


def chapter_samples(chunks: Column, rate: int = RATE, pause_ms: int = PAUSE_MS) -> Column:
    """Samples of a chapter: its chunks with pauses between them; none without chunks."""
    spoken = F.aggregate(F.transform(chunks, lambda c: tone_samples(F.char_length(c), rate)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return spoken + F.greatest(F.size(chunks) - 1, F.lit(0)) * F.lit(rate * pause_ms // 1000)


def duration_seconds(file_bytes: Column, rate: int = RATE) -> Column:
    """Length of a mono 16-bit file; 0 if it is missing or too short."""
    return F.coalesce(F.when(file_bytes > HEADER, (file_bytes - HEADER) / 2 / F.lit(rate)), F.lit(0.0))


def finish_samples(signal: Column, rate: int) -> Column:
    """Float samples to 16 bits: mean removed, gain to the peak, short linear fades at both ends.

    Samples that aren't finite become 0 and don't count in the mean. Sums are in double precision.
    """

    def finite(v: Column) -> Column:
        return ~F.isnan(v) & (F.abs(v) != float("inf"))

    def mean(x: Column) -> Column:
        good = F.filter(x, finite)
        return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, v: a + v) / F.size(good)).otherwise(F.lit(0.0))

    def gain(x: Column) -> Column:
        peak = F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))
        return F.when(peak > 0, F.least(F.lit(PEAK) / peak, F.lit(MAX_GAIN))).otherwise(F.lit(1.0))

    def shape(x: Column, g: Column) -> Column:
        n = F.size(x)
        fade = F.least(F.lit(rate // 100), F.floor(n / 2)).cast("int")

        def sample(v: Column, i: Column) -> Column:
            up = F.when(i < fade, i / fade).otherwise(F.lit(1.0))
            down = F.when(i >= n - fade, (n - i) / fade).otherwise(F.lit(1.0))
            return (F.greatest(F.least(v * g * up * down, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int").cast("smallint")

        return F.transform(x, sample)

    def centred(x: Column, m: Column) -> Column:
        return F.transform(x, lambda v: F.when(finite(v), v - m).otherwise(F.lit(0.0)))

    doubles = F.transform(signal, lambda v: v.cast("double"))
    return bound(doubles, lambda x: bound(mean(x), lambda m: bound(centred(x, m), lambda c: bound(gain(c), lambda g: shape(c, g)))))


def parse_voice(spec: Column, generation: str = "v1.0", preset: str = "") -> Column:
    """struct<voice, speed> of name[@speed]: names in small letters, - as _, no blanks; blank and auto the default.

    Without a speed that can be read it is 1, or the faster one of the preset 'speed'.
    """
    name = F.regexp_replace(F.translate(F.lower(F.trim(F.substring_index(spec, "@", 1))), "-", "_"), " ", "")
    voice = F.when(name.isin("", "auto") | name.isNull(), F.lit(DEFAULT_VOICES[generation])).otherwise(name)
    after = F.when(F.instr(spec, "@") > 0, F.trim(F.regexp_extract(spec, "^[^@]*@(.*)$", 1)))
    speed = after.try_cast("double") if generation == "v1.0" else after.try_cast("int").cast("double")
    whole = F.lit(True) if generation == "v1.0" else after.rlike("^[+-]?[0-9]+$")
    return F.struct(voice.alias("voice"), F.coalesce(F.when(whole, speed), F.lit(FAST[generation] if preset == "speed" else 1.0)).alias("speed"))


def voice_style(packs: Column, voice: Column, tokens: Column, default: str | None = None) -> Column:
    """The style of a voice for a text of so many tokens, from map<voice, array<array<array<float>>>>.

    Longer texts than there are rows take the last row. An unknown voice takes the default, else null.
    """
    pack = F.try_element_at(packs, voice)
    if default is not None:
        pack = F.coalesce(pack, F.try_element_at(packs, F.lit(default)))
    return bound(pack, lambda rows: F.get(F.get(rows, F.greatest(F.least(tokens, F.size(rows)), F.lit(1)) - 1), 0))


def percent(position: Column, total: Column) -> Column:
    """Whole percent, halves away from zero."""
    return F.round(F.lit(100.0) * position / total).cast("int")


def resolve_jobs(spec: str, total: int, cores: int) -> int:
    """Number of workers: a positive number, or 'auto' for the cores; no more than there is work, but one."""
    if spec.strip().lower() == "auto":
        return min(max(cores, 1), max(total, 1))
    jobs = int(spec) if spec.strip().isdigit() else 0
    if jobs < 1:
        raise ValueError(f"jobs must be a positive number or auto, not {spec!r}")
    return min(jobs, max(total, 1))
