"""Signal processing of waveform frames (an array column and a sampling rate).

Spectra, filters and entropies are numpy kernels run over Arrow batches; the
matching of spectral peaks against fault frequencies, ISO zones and statistics
that SQL can say are column expressions and joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.config import SignalSettings
from condmon.functions import stats
from condmon.functions.lineage import written

#: Zone limits (mm/s) of the machine classes.
ISO_LIMITS = {"class1": (0.71, 1.8, 4.5), "class2": (1.12, 2.8, 7.1), "class3": (1.8, 4.5, 11.2), "class4": (2.8, 7.1, 18.0)}
#: Samples that sample entropy looks at, and its embedding length and tolerance.
ENTROPY_SAMPLES, ENTROPY_M, ENTROPY_R = 2000, 2, 0.2
#: Samples that a kernel over many frames takes at a time.
TOGETHER = 1 << 20
#: Rows that one group of a fleet's matches gives at most, about; peaks in one list; parts that the groups are dealt over,
#: a number of their own as so few bytes give so many rows that parts dealt by bytes would be too few.
GIVEN, LISTED, PARTS = 1 << 24, 4096, 256


# Kernels -------------------------------------------------------------------


def window(name: str, n: int) -> np.ndarray:
    """Symmetric window (denominator n - 1); unknown names are rectangular."""
    made = {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman}.get(name)
    return made(n) if made is not None and n > 1 else np.ones(n)


def spectrum(x: np.ndarray, rate: float, name: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and magnitudes (divided by n, one-sided without doubling) after padding to a power of two."""
    n = 1 << max(0, math.ceil(math.log2(max(1, len(x)))))
    magnitude = np.abs(np.fft.rfft(x * window(name, len(x)), n))[: n // 2] / n
    return np.arange(n // 2) * rate / n, magnitude


def spectral_peaks(frequency: np.ndarray, magnitude: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of strict local maxima over ``threshold`` of the largest magnitude, largest first."""
    top = magnitude.max(initial=0.0)
    if top <= 0:
        return np.zeros(0, dtype=int)
    inner = np.flatnonzero((magnitude[1:-1] > magnitude[:-2]) & (magnitude[1:-1] > magnitude[2:])) + 1
    inner = inner[magnitude[inner] / top > threshold]
    return inner[np.argsort(-magnitude[inner], kind="stable")]


def spectral_features(frequency: np.ndarray, magnitude: np.ndarray) -> dict[str, float]:
    total = magnitude.sum()
    centroid = float((frequency * magnitude).sum() / total) if total else 0.0
    spread = float(np.sqrt(((frequency - centroid) ** 2 * magnitude).sum() / total)) if total else 0.0
    rms = float(np.sqrt((magnitude**2).mean())) if len(magnitude) else 0.0
    return {"centroid": centroid, "spread": spread, "spectral_rms": rms, "spectral_crest": float(magnitude.max() / rms) if rms else 0.0, "energy": float((magnitude**2).sum())}


def sample_entropy(x: np.ndarray, m: int = ENTROPY_M, r: float = ENTROPY_R) -> float:
    """-ln(A/B) with tolerance r * deviation; both lengths count pairs i < j < n - m; 0 without matches."""
    x = x[-ENTROPY_SAMPLES:]
    n, tol = len(x), r * x.std()
    if n < m + 2 or tol == 0:
        return 0.0
    places = n - m
    close = np.abs(x[:, None] - x[None, :]) <= tol
    short = np.ones((places, places), dtype=bool)
    for k in range(m):
        short &= close[k : k + places, k : k + places]
    long = short & close[m : m + places, m : m + places]
    upper = np.triu_indices(places, 1)
    b, a = int(short[upper].sum()), int(long[upper].sum())
    return -math.log(a / b) if a and b else 0.0


def autocorrelation(x: np.ndarray, lags: int = 10) -> np.ndarray:
    """Lags 0..lags over n * variance; empty for a constant."""
    d = x - x.mean() if len(x) else x
    power = (d**2).sum()
    return np.array([(d[: len(d) - k] * d[k:]).sum() / power for k in range(min(lags, len(x) - 1) + 1)]) if power else np.zeros(0)


def periodicity(acf: np.ndarray, least: float = 0.3) -> int | None:
    """First interior maximum from lag 2 on that is over ``least``."""
    for k in range(2, len(acf) - 1):
        if acf[k] > acf[k - 1] and acf[k] > acf[k + 1] and acf[k] > least:
            return k
    return None


def time_peaks(x: np.ndarray, height: float | None, distance: int, kind: str = "both") -> list[tuple[int, float, str]]:
    """Strict extrema in order, each at least ``distance`` after the last one taken; with a height, positives reach it and negatives its opposite."""
    up, down = (x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]), (x[1:-1] < x[:-2]) & (x[1:-1] < x[2:])
    if height is not None:
        up, down = up & (x[1:-1] >= height), down & (x[1:-1] <= -height)
    up, down = up & (kind in ("positive", "both")), down & (kind in ("negative", "both"))
    out: list[tuple[int, float, str]] = []
    for i in (np.flatnonzero(up | down) + 1).tolist():
        if not out or i - out[-1][0] >= distance:
            out.append((i, float(x[i]), "positive" if up[i - 1] else "negative"))
    return out


def butterworth(cutoff: float, rate: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Second-order section by the bilinear transform with pre-warping."""
    k = math.tan(math.pi * min(0.999, max(0.001, 2 * cutoff / rate)) / 2)
    norm = 1 + math.sqrt(2) * k + k * k
    b = np.array([1.0, -2.0, 1.0]) if high else np.array([1.0, 2.0, 1.0]) * k * k
    return b / norm, np.array([norm, 2 * (k * k - 1), 1 - math.sqrt(2) * k + k * k]) / norm


def recurse(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The section run over the last axis of many frames at once, from rest."""
    y = np.empty_like(x)
    s1, s2 = np.zeros(x.shape[:-1]), np.zeros(x.shape[:-1])
    for i in range(x.shape[-1]):
        v = x[..., i]
        out = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * out + s2, b[2] * v - a[2] * out
        y[..., i] = out
    return y


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    return recurse(recurse(x, b, a)[..., ::-1], b, a)[..., ::-1]


def centered_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of the ``width // 2`` samples on either side, fewer at the ends (last axis)."""
    n, h = x.shape[-1], width // 2
    total = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)
    lo, hi = np.maximum(0, np.arange(n) - h), np.minimum(n, np.arange(n) + h + 1)
    return (total[..., hi] - total[..., lo]) / (hi - lo)


def band_pass(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """High-pass then low-pass without phase; moving averages where the band or the frame does not allow it."""
    if not 0 < low < high < rate / 2 or x.shape[-1] < 12:
        slow = centered_mean(x, max(3, int(rate / low) if low > 0 else 3))
        return centered_mean(x - slow, max(3, int(rate / high) if high > 0 else 3))
    return zero_phase(zero_phase(x, *butterworth(low, rate, True)), *butterworth(high, rate, False))


def envelope(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    return centered_mean(np.abs(band_pass(x, rate, low, high)), max(3, int(rate / low / 2) if low > 0 else 3))


def cepstrum(magnitude: np.ndarray) -> np.ndarray:
    """Cosine sum of the log magnitudes over their number."""
    log = np.log(np.maximum(magnitude, 1e-10))
    m = len(log)
    return np.real(np.fft.fft(log)) / m if m else log


def rahmonics(c: np.ndarray, rate: float, least: float = 0.1) -> list[tuple[float, float, float]]:
    """Local maxima of abs(c) between 1 and 100 ms: (quefrency, signed value, share of the largest abs(c) past the first five samples), largest first."""
    size, at = np.abs(c), np.arange(6, max(6, len(c) - 1))
    top = size[5:].max(initial=0.0)
    if not len(at) or not top > 0:
        return []
    q = at / rate
    at = at[(size[at] > size[at - 1]) & (size[at] > size[at + 1]) & (q >= 0.001) & (q <= 0.1) & (size[at] / top > least)]
    return [(float(i / rate), float(c[i]), float(size[i] / top)) for i in at[np.argsort(-size[at], kind="stable")]]


# Frames --------------------------------------------------------------------

PEAKS = T.ArrayType(T.StructType([T.StructField("frequency", T.DoubleType()), T.StructField("magnitude", T.DoubleType()), T.StructField("normalized", T.DoubleType())]))


def per_frame(df: DataFrame, fields: list[T.StructField], kernel: Callable[[np.ndarray, float], dict], samples: str = "samples", rate: str = "sampling_rate", size: int | None = None, first: Callable[[np.ndarray, float], np.ndarray] | None = None) -> DataFrame:
    """Adds the kernel's results for each frame; with ``size`` only its newest samples count.  Frames that are null or hold a value that is not finite get nulls.

    ``first`` runs over the last axis of many frames of one length and rate at
    once; the kernel then gets its rows instead of the samples.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, rates = (batch.column(batch.schema.get_field_index(c)) for c in (samples, rate))
            out: list[dict] = [{} for _ in range(batch.num_rows)]
            alike: dict[tuple, list[tuple[int, np.ndarray]]] = {}
            for i, (frame, fs) in enumerate(zip(frames, rates.to_pylist(), strict=True)):
                x = np.asarray(frame.values.to_numpy(zero_copy_only=False), dtype=np.float64) if frame.is_valid else None
                if x is None or not len(x) or fs is None or not np.isfinite(x).all():
                    continue
                x = x[-size:] if size else x
                if first is None:
                    out[i] = kernel(x, fs)
                else:
                    alike.setdefault((len(x), fs), []).append((i, x))
            for (n, fs), held in alike.items():
                step = max(1, TOGETHER // n)
                for lot in (held[k : k + step] for k in range(0, len(held), step)):
                    for (i, _), y in zip(lot, first(np.stack([x for _, x in lot]), fs), strict=True):
                        out[i] = kernel(y, fs)
            columns = [pa.array([r.get(n) for r in out], type=k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *names])

    return df.select(*kept).mapInArrow(run, schema)


def _peaks(frequency: np.ndarray, magnitude: np.ndarray, threshold: float) -> list[dict]:
    top = magnitude.max(initial=0.0)
    return [{"frequency": float(frequency[i]), "magnitude": float(magnitude[i]), "normalized": float(magnitude[i] / top)} for i in spectral_peaks(frequency, magnitude, threshold)]


def fft(df: DataFrame, s: SignalSettings, full: bool = False) -> DataFrame:
    """Spectral peaks, ``dominant_frequency`` (null without a peak) and spectral features of each frame; ``full`` adds the spectrum."""
    fields = [T.StructField("peaks", PEAKS), T.StructField("dominant_frequency", T.DoubleType())]
    fields += [T.StructField(n, T.DoubleType()) for n in ("centroid", "spread", "spectral_rms", "spectral_crest", "energy")]
    fields += [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("frequencies", "magnitudes") if full]

    def kernel(x: np.ndarray, rate: float) -> dict:
        f, m = spectrum(x, rate, s.window)
        found = _peaks(f, m, s.peak_threshold)
        return {"peaks": found, "dominant_frequency": found[0]["frequency"] if found else None, **spectral_features(f, m), "frequencies": f.tolist(), "magnitudes": m.tolist()}

    return per_frame(df, fields, kernel, size=s.fft_size)


def vibration_columns(x: Column) -> dict[str, Column]:
    """Vibration features as aggregates of a column of samples; kurtosis is excess, both moments of the population."""
    rms, level, spread = stats.rms(x), F.avg(F.abs(x)), F.stddev_pop(x)
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))
    return {
        "rms": rms, "peak": F.max(F.abs(x)), "peak_to_peak": F.max(x) - F.min(x), "mean": F.avg(x), "sd": spread,
        "crest": ratio(F.max(F.abs(x)), rms), "form": ratio(rms, level), "impulse": ratio(F.max(F.abs(x)), level),
        "kurtosis": F.when(spread == 0, F.lit(0.0)).otherwise(F.kurtosis(x)), "skewness": F.when(spread == 0, F.lit(0.0)).otherwise(F.skewness(x)),
    }


def vibration(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Vibration features and health (100 less 20 for crest over 5, 20 for abs kurtosis over 3, 10 for abs skewness over 1) of each group of samples."""
    made = df.groupBy(*keys).agg(*[c.alias(n) for n, c in vibration_columns(F.col(value)).items()], F.count(value).alias("samples"))
    off = lambda c, limit, points: F.when(c > limit, points).otherwise(0)
    return made.withColumn("health", F.lit(100) - off(F.col("crest"), 5, 20) - off(F.abs("kurtosis"), 3, 20) - off(F.abs("skewness"), 1, 10))


def vibration_verdict(features: DataFrame, s: SignalSettings, window_rows: int = 100) -> DataFrame:
    """Adds ``is_anomaly``: crest or abs kurtosis over its limit, given at least min(10, window) samples."""
    enough = F.col("samples") >= min(10, window_rows)
    return features.withColumn("is_anomaly", F.when(enough, (F.col("crest") > s.crest_limit) | (F.abs("kurtosis") > s.kurtosis_limit)))


def velocity(rms: Column, unit: str, rpm: float | None = None) -> Column:
    """Velocity in mm/s of a value in mm_s, m_s, g or m_s2; null for raw and unknown units."""
    hz = rpm / 60 if rpm else 50.0
    factor = {"mm_s": 1.0, "m_s": 1000.0, "g": 9810 / (2 * math.pi * hz), "m_s2": 1000 / (2 * math.pi * hz)}.get(unit)
    return rms * F.lit(factor) if factor is not None else F.lit(None).cast("double")


def iso_zone(df: DataFrame, speed: str, machine_class: str = "class2") -> DataFrame:
    """Adds ``zone`` (A to D; N/A without a velocity), ``zone_severity`` and ``zone_progress`` (percent of the way through the zone, D open)."""
    a, b, c = ISO_LIMITS.get(machine_class, ISO_LIMITS["class2"])
    v = F.col(speed)
    zone = F.when(v.isNull(), "N/A").when(v <= a, "A").when(v <= b, "B").when(v <= c, "C").otherwise("D")
    progress = F.when(v <= a, v / a).when(v <= b, (v - a) / (b - a)).when(v <= c, (v - b) / (c - b)).when(v.isNotNull(), F.lit(1.0))
    severity = F.create_map(*[F.lit(x) for p in (("A", "good"), ("B", "acceptable"), ("C", "warning"), ("D", "critical"), ("N/A", "unknown")) for x in p])
    return df.withColumn("zone", zone).withColumn("zone_severity", severity[F.col("zone")]).withColumn("zone_progress", progress * 100)


def advanced(df: DataFrame) -> DataFrame:
    """Adds ``sample_entropy``, ``acf`` (lags 0 to 10), ``period`` (lag of the first peak) of each frame."""
    fields = [T.StructField("sample_entropy", T.DoubleType()), T.StructField("acf", T.ArrayType(T.DoubleType())), T.StructField("period", T.IntegerType())]

    def kernel(x: np.ndarray, rate: float) -> dict:
        acf = autocorrelation(x)
        return {"sample_entropy": sample_entropy(x), "acf": acf.tolist(), "period": periodicity(acf)}

    return per_frame(df, fields, kernel)


def peaks(df: DataFrame, s: SignalSettings, kind: str = "both") -> DataFrame:
    """Adds ``peaks`` (index, value, direction) and their statistics in the time domain.  The height is the settings' peak threshold; ``is_peak`` tells of the last sample, which is never an inner one, and stays false."""
    item = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("direction", T.StringType())])
    fields = [T.StructField("peaks", T.ArrayType(item)), *[T.StructField(n, T.DoubleType()) for n in ("average_peak", "max_peak", "min_peak", "peak_frequency")], T.StructField("is_peak", T.BooleanType())]

    def kernel(x: np.ndarray, rate: float) -> dict:
        found = time_peaks(x, s.peak_threshold, s.min_distance, kind)
        size = [abs(v) for _, v, _ in found]
        return {"peaks": [{"index": i, "value": v, "direction": d} for i, v, d in found], "average_peak": float(np.mean(size)) if size else None, "max_peak": max(size, default=None), "min_peak": min(size, default=None), "peak_frequency": len(found) / len(x), "is_peak": False}

    return per_frame(df, fields, kernel)


def envelope_spectrum(df: DataFrame, s: SignalSettings, threshold: float = 0.05) -> DataFrame:
    """Adds ``envelope`` and ``peaks`` of its spectrum."""
    fields = [T.StructField("envelope", T.ArrayType(T.DoubleType())), T.StructField("peaks", PEAKS)]

    def kernel(e: np.ndarray, rate: float) -> dict:
        return {"envelope": e.tolist(), "peaks": _peaks(*spectrum(e, rate, s.window), threshold)}

    return per_frame(df, fields, kernel, size=s.fft_size, first=lambda x, rate: envelope(x, rate, s.low_hz, s.high_hz))


def fault_table(spark, rates: dict[str, float], harmonics: int = 3) -> DataFrame:
    """(fault, harmonic, target) for each fault frequency, for example BPFO, BPFI, BSF, FTF, 1X, 2X."""
    rows = [(n, h, f * h) for n, f in rates.items() if f and f > 0 for h in range(1, harmonics + 1)]
    return spark.createDataFrame(rows, "fault string, harmonic int, target double")


def match_faults(frames: DataFrame, faults: DataFrame, s: SignalSettings, keys: list[str], high: float = 0.5, low: float = 0.2) -> DataFrame:
    """Peaks within the relative tolerance of a fault frequency: one row a match, with ``severity`` by magnitude.  The fault table has a few rows and is broadcast."""
    each = frames.select(*keys, F.explode("peaks").alias("p")).select(*keys, "p.*")
    near = F.abs(F.col("frequency") - F.col("target")) / F.col("target") <= s.tolerance
    level = F.when(F.col("magnitude") > high, "high").when(F.col("magnitude") > low, "medium").otherwise("low")
    return each.join(F.broadcast(faults), near).withColumn("deviation", F.abs(F.col("frequency") - F.col("target")) / F.col("target")).withColumn("severity", level)


def fleet_faults(machines: DataFrame, keys: list[str], rates: dict[str, Column], harmonics: int = 3) -> DataFrame:
    """(keys, fault, harmonic, target) for every machine of a table, each rate a column of its own; rates that are null or not over 0 have no fault."""
    named = F.array(*[F.struct(F.lit(n).alias("fault"), c.cast("double").alias("rate")) for n, c in rates.items()])
    each = machines.select(*keys, F.explode(named).alias("f")).where("f.rate > 0")
    return each.select(*keys, F.col("f.fault").alias("fault"), F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("harmonic"), F.col("f.rate").alias("__rate")).withColumn("target", F.col("__rate") * F.col("harmonic")).drop("__rate")


def match_fleet(frames: DataFrame, faults: DataFrame, s: SignalSettings, machine: list[str], keys: list[str], high: float = 0.5, low: float = 0.2) -> DataFrame:
    """:func:`match_faults` with a fault table for each machine, of any size (:func:`fleet_faults`); ``machine`` are columns of both.

    Peaks of many frames share few frequencies, so the different ones are matched
    first, by a band join: targets fall into buckets of a constant ratio, a
    frequency is in the few that its tolerance reaches, and both sides meet by
    machine and bucket.  Each match then meets the peaks of its frequency, packed
    in lists; the matches of a frequency are dealt over as many lots as its rows
    need, each with the lists.  Only the last step, the result itself, grows with
    frames times machines.  Nothing is broadcast by hand.  Null machines match
    nothing; frequencies of 0 are no peaks.
    """
    width = math.log1p(max(s.tolerance, 1e-3))
    bucket = lambda f: F.floor(F.ln(f) / width)
    own, at = [*dict.fromkeys([*machine, *keys])], [*machine, "frequency"]
    each = frames.select(*own, F.explode("peaks").alias("p")).select(*own, "p.*").where((F.col("frequency") > 0) & (F.col("frequency") < math.inf))
    each = written(each, "fleet-peaks")
    packed = [c for c in each.columns if c not in at]
    # one bucket more on either side: the ends of a band are rounded
    reach = F.sequence(bucket(F.col("frequency") / (1 + s.tolerance)) - 1, bucket(F.col("frequency") / max(1 - s.tolerance, 1e-9)) + 1)
    different = each.groupBy(*at).agg(F.count(F.lit(1)).alias("__peaks")).withColumn("__bucket", F.explode(reach))
    near = faults.where("target > 0").withColumn("__bucket", bucket(F.col("target")))
    deviation = F.abs(F.col("frequency") - F.col("target")) / F.col("target")
    met = different.join(near, [*machine, "__bucket"]).withColumn("deviation", deviation).where(F.col("deviation") <= s.tolerance).drop("__bucket")
    met = written(met, "fleet-met")
    n = F.col("__met")
    lots = F.greatest(F.lit(1), F.least(n, F.ceil(n * F.col("__peaks") / GIVEN))).alias("__lots")
    sizes = met.groupBy(*at, "__peaks").agg(F.count(F.lit(1)).alias("__met")).select(*at, "__peaks", lots)
    found = [c for c in met.columns if c not in (*at, "__peaks")]
    dealt = met.drop("__peaks").join(sizes.drop("__peaks"), at).withColumn("__lot", F.pmod(F.xxhash64(*found), F.col("__lots"))).drop("__lots")
    # as text, for a join deals doubles anew
    text, on = F.col("frequency").cast("string").alias("__hz"), [*machine, "__hz", "__lot"]
    dealt = dealt.select("*", text).repartition(PARTS, *on)
    cut = F.pmod(F.xxhash64(*packed), F.ceil(F.col("__peaks") / LISTED)).alias("__cut")
    lists = each.join(sizes, at).groupBy(*at, "__lots", cut).agg(F.collect_list(F.struct(*packed)).alias("__list"))
    lists = lists.select(*machine, text, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__lots") - 1)).alias("__lot"), "__list")
    level = F.when(F.col("magnitude") > high, "high").when(F.col("magnitude") > low, "medium").otherwise("low")
    out = dealt.join(lists, on).select(*at, *found, F.explode("__list").alias("__p")).select(*at, *found, "__p.*")
    return out.select(*each.columns, *found, level.alias("severity"))


def cepstral(df: DataFrame, s: SignalSettings) -> DataFrame:
    """Adds ``cepstrum`` and ``rahmonics`` (quefrency, magnitude, normalized, frequency) of each frame."""
    item = T.StructType([T.StructField(n, T.DoubleType()) for n in ("quefrency", "magnitude", "normalized", "frequency")])
    fields = [T.StructField("cepstrum", T.ArrayType(T.DoubleType())), T.StructField("rahmonics", T.ArrayType(item))]

    def kernel(x: np.ndarray, rate: float) -> dict:
        c = cepstrum(spectrum(x, rate, s.window)[1])
        return {"cepstrum": c.tolist(), "rahmonics": [{"quefrency": q, "magnitude": m, "normalized": r, "frequency": 1 / q} for q, m, r in rahmonics(c, rate)]}

    return per_frame(df, fields, kernel, size=s.fft_size)


def gear_table(spark, teeth: int | list[int], rpm: float, sidebands: int = 3) -> DataFrame:
    """Mesh frequency of each gear (``gear`` from 1, by its teeth) and its sidebands at multiples of the shaft's frequency (``harmonic``)."""
    shaft, gears = rpm / 60, [teeth] if isinstance(teeth, int) else list(teeth)
    rows = [(g, t, "sideband" if k else "gear_mesh", k, shaft * (t + k)) for g, t in enumerate(gears, 1) for k in range(sidebands + 1)]
    return spark.createDataFrame(rows, "gear int, teeth int, fault string, harmonic int, target double")


def match_gears(frames: DataFrame, gears: DataFrame, keys: list[str], tolerance: float = 0.1) -> DataFrame:
    """Rahmonics whose frequency is nearer than the tolerance to a gear frequency; ``severity`` by share of the largest, stricter for a mesh than for a sideband."""
    each = frames.select(*keys, F.explode("rahmonics").alias("p")).select(*keys, "p.*")
    near = F.abs(F.col("frequency") - F.col("target")) / F.col("target") < tolerance
    x, mesh = F.col("normalized"), F.col("fault") == "gear_mesh"
    level = F.when(x > F.when(mesh, 0.5).otherwise(0.3), "high").when(~mesh | (x > 0.25), "medium").otherwise("low")
    return each.join(F.broadcast(gears), near).withColumn("severity", level)


def frame_verdict(frames: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``fault_count`` and ``has_fault`` to each frame from the matches of :func:`match_faults` or :func:`match_gears`."""
    counts = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("fault_count"))
    out = frames.join(counts, keys, "left").withColumn("fault_count", F.coalesce("fault_count", F.lit(0)))
    return out.withColumn("has_fault", F.col("fault_count") > 0)
