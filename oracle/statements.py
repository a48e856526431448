"""SQL with the results of the catalogue's queries.

Constants: rate 32 Hz, windows of 33 samples every 16, Welch segments of 16
samples (2 Hz bins), bands Delta .5-4, Theta 4-8, Alpha 8-12, Beta 12-30.
"""

from __future__ import annotations

import numpy as np

STATEMENTS: dict[str, str] = {}

RATE, WINDOW, STRIDE, NFFT = 32, 33, 16, 16
FEATURES = [f"f{i:02d}" for i in range(64)]
ELECTRODES = ["click", "error", "purchase", "signup", "view"]
BANDS = [("Delta", 0.5, 4.0), ("Theta", 4.0, 8.0), ("Alpha", 8.0, 12.0), ("Beta", 12.0, 30.0)]
ELECTRODE_FEATURES = [
    "TotalPower", "TotalEnergy", "SpectralEntropy", "HjorthActivity",
    "HjorthMobility", "HjorthComplexity", "HjorthIndex",
]
BAND_FEATURES = ["Power", "SpectralEntropy", "HjorthMobility", "HjorthComplexity", "HjorthIndex"]
EPOCH_FEATURES = ["Mean", "Std", "Variance", "RMS", "HjorthMobility"]


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


# --- shared steps -----------------------------------------------------------------------

SIGNAL = """
signal AS (
  SELECT 'sub-' || CAST(user_id % 8 AS VARCHAR) AS SubjectID, event_type AS Electrode,
         event_id, value AS x,
         row_number() OVER (PARTITION BY user_id % 8, event_type ORDER BY ts, event_id) - 1 AS n
  FROM events),
lengths AS (SELECT SubjectID, Electrode, count(*) AS len FROM signal GROUP BY ALL)"""


def grid() -> str:
    return f"""
recs AS (SELECT SubjectID, max(len) AS n_samples FROM lengths GROUP BY ALL),
grid AS (
  SELECT SubjectID, i AS epoch_ix, CAST(trunc(i * 0.5e0 * {RATE}e0) AS BIGINT) AS start_sample
  FROM (SELECT SubjectID, n_samples, unnest(range(0, n_samples)) AS i FROM recs)
  WHERE i * 0.5e0 < (n_samples - 1) / {RATE}e0 - 1.0e0)"""


ANNOTATIONS = """
annotations AS (
  SELECT SubjectID, n / 32e0 AS onset, 0.25e0 AS duration,
         CASE event_id % 3 WHEN 0 THEN 'BAD_boundary' WHEN 1 THEN 'bad_blink'
              ELSE 'eyes closed' END AS description
  FROM signal WHERE x > 300),
bad AS (SELECT SubjectID, onset, onset + duration AS off FROM annotations
        WHERE description ILIKE 'bad%'),
touched AS (
  SELECT DISTINCT g.SubjectID, g.epoch_ix, g.start_sample FROM grid g JOIN bad b
    ON g.SubjectID = b.SubjectID AND g.start_sample / 32e0 < b.off
   AND (g.start_sample + 32) / 32e0 > b.onset)"""

REJECTED = """
epochs AS (
  SELECT SubjectID, epoch_ix, start_sample,
         row_number() OVER (PARTITION BY SubjectID ORDER BY epoch_ix) - 1 AS epoch_no
  FROM grid ANTI JOIN touched USING (SubjectID, epoch_ix))"""

UNREJECTED = """
epochs AS (SELECT SubjectID, epoch_ix, start_sample, epoch_ix AS epoch_no FROM grid)"""

ALL_SAMPLES = f"""
samples AS (
  SELECT s.SubjectID, 'ep-' || CAST(e.epoch_no AS VARCHAR) AS EpochID, s.Electrode, s.n,
         CAST(s.n - e.start_sample AS INTEGER) AS j, s.x
  FROM signal s JOIN epochs e ON s.SubjectID = e.SubjectID
   AND s.n >= e.start_sample AND s.n < e.start_sample + {WINDOW})"""

# Channels that fill the epoch.
SAMPLES = f"""{ALL_SAMPLES[:-1]} QUALIFY count(*) OVER (PARTITION BY s.SubjectID, e.epoch_no, s.Electrode) = {WINDOW})"""

DETRENDED = """
detrended AS (
  SELECT *, x - (regr_slope(x, j) OVER w * j + regr_intercept(x, j) OVER w) AS y
  FROM samples WINDOW w AS (PARTITION BY SubjectID, EpochID, Electrode))"""

HJORTH = """
d1 AS (
  SELECT *, y - lag(y) OVER (PARTITION BY SubjectID, EpochID, Electrode ORDER BY j) AS d
  FROM detrended),
d2 AS (
  SELECT *, d - lag(d) OVER (PARTITION BY SubjectID, EpochID, Electrode ORDER BY j) AS dd FROM d1),
v AS (
  SELECT SubjectID, EpochID, Electrode, avg(y) AS m, var_pop(y) AS v0, var_pop(d) AS v1,
         var_pop(dd) AS v2, sqrt(avg(y * y)) AS rms
  FROM d2 GROUP BY ALL),
hj AS (
  SELECT *, sqrt(v1 / nullif(v0, 0)) AS mob,
         sqrt(v2 / nullif(v1, 0)) / nullif(sqrt(v1 / nullif(v0, 0)), 0) AS comp FROM v),
hjorth AS (
  SELECT *, v0 AS HjorthActivity, mob AS HjorthMobility, comp AS HjorthComplexity,
         2 * comp + 100 / nullif(2 * mob, 0) AS HjorthIndex FROM hj)"""

PSD = f"""
segments AS (
  SELECT SubjectID, EpochID, Electrode, j // {NFFT} AS seg, j % {NFFT} AS t,
         y - avg(y) OVER (PARTITION BY SubjectID, EpochID, Electrode, j // {NFFT}) AS y
  FROM detrended WHERE j < {WINDOW // NFFT * NFFT}),
weighted AS (
  SELECT *, y * (0.54 - 0.46 * cos(2 * pi() * t / {NFFT})) AS yw FROM segments),
fourier AS (
  SELECT SubjectID, EpochID, Electrode, seg, k,
         sum(yw * cos(2 * pi() * k * t / {NFFT})) AS re,
         sum(yw * sin(2 * pi() * k * t / {NFFT})) AS im
  FROM weighted CROSS JOIN (SELECT unnest(range(1, {NFFT // 2 + 1})) AS k) GROUP BY ALL),
hamming AS (
  SELECT sum((0.54 - 0.46 * cos(2 * pi() * t / {NFFT})) ** 2) AS energy
  FROM (SELECT unnest(range(0, {NFFT})) AS t)),
psd AS (
  SELECT SubjectID, EpochID, Electrode, CAST(k AS INTEGER) AS k, k * {RATE / NFFT}e0 AS freq,
         avg(re * re + im * im) * (CASE WHEN k = {NFFT // 2} THEN 1 ELSE 2 END)
           / ({RATE} * (SELECT energy FROM hamming)) AS p
  FROM fourier GROUP BY SubjectID, EpochID, Electrode, k),
rel AS (
  SELECT SubjectID, EpochID, Electrode, k, freq,
         p / nullif(sum(p) OVER (PARTITION BY SubjectID, EpochID, Electrode), 0) AS p FROM psd),
bands AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {lo}e0, {hi}e0)" for b, lo, hi in BANDS)})
          AS t(WaveBand, fmin, fmax)),
inband AS (
  SELECT r.SubjectID, r.EpochID, r.Electrode, b.WaveBand, r.p,
         r.p / nullif(sum(r.p) OVER (PARTITION BY SubjectID, EpochID, Electrode, WaveBand), 0) AS q
  FROM rel r JOIN bands b ON r.freq >= b.fmin AND r.freq < b.fmax),
per_band AS (
  SELECT SubjectID, EpochID, Electrode, WaveBand, avg(p) AS Power,
         -sum(q * log2(q + 1e-12)) AS SpectralEntropy
  FROM inband GROUP BY ALL),
per_channel AS (
  SELECT SubjectID, EpochID, Electrode, avg(p) AS TotalPower, sum(p * p) AS TotalEnergy,
         -sum(p * log2(p + 1e-12)) AS SpectralEntropy
  FROM rel GROUP BY ALL)"""

LONG = """
electrode_wide AS (
  SELECT SubjectID, EpochID, Electrode, TotalPower, TotalEnergy, SpectralEntropy, HjorthActivity,
         HjorthMobility, HjorthComplexity, HjorthIndex
  FROM per_channel JOIN hjorth USING (SubjectID, EpochID, Electrode)),
band_wide AS (
  SELECT SubjectID, EpochID, Electrode, WaveBand, Power, SpectralEntropy, HjorthMobility,
         HjorthComplexity, HjorthIndex
  FROM per_band JOIN hjorth USING (SubjectID, EpochID, Electrode)),
epoch_wide AS (
  SELECT SubjectID, EpochID, avg(m) AS Mean, avg(sqrt(v0)) AS Std, avg(v0) AS Variance,
         avg(rms) AS RMS, avg(mob) AS HjorthMobility
  FROM hj GROUP BY ALL),
feature_rows AS (
  SELECT SubjectID, EpochID, Electrode, NULL AS WaveBand, FeatureName, FeatureValue,
         'electrode' AS table_type
  FROM electrode_wide UNPIVOT INCLUDE NULLS (FeatureValue FOR FeatureName IN (
    TotalPower, TotalEnergy, SpectralEntropy, HjorthActivity, HjorthMobility, HjorthComplexity,
    HjorthIndex))
  UNION ALL
  SELECT SubjectID, EpochID, Electrode, WaveBand, FeatureName, FeatureValue, 'band'
  FROM band_wide UNPIVOT INCLUDE NULLS (FeatureValue FOR FeatureName IN (
    Power, SpectralEntropy, HjorthMobility, HjorthComplexity, HjorthIndex))
  UNION ALL
  SELECT SubjectID, EpochID, NULL, NULL, FeatureName, FeatureValue, 'epoch'
  FROM epoch_wide UNPIVOT INCLUDE NULLS (FeatureValue FOR FeatureName IN (
    Mean, Std, Variance, RMS, HjorthMobility)))"""

TO_EPOCHS = [SIGNAL, grid(), ANNOTATIONS, REJECTED]
TO_SAMPLES = [*TO_EPOCHS, SAMPLES, DETRENDED]
TO_ALL = [*TO_SAMPLES, HJORTH, PSD, LONG]


def put(key: str, steps: list[str], select: str) -> None:
    with_ = "WITH " + ",".join(steps) + "\n" if steps else ""
    STATEMENTS[key] = with_ + select


# --- sources and sinks --------------------------------------------------------------------

put("subjects_by_group", [], """
SELECT c_name AS SubjectID, c_mktsegment AS "Group" FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")
put("subject_prefix_normalised", [], """
SELECT 'sub-' || CAST(user_id AS VARCHAR) AS SubjectID, count(*) AS samples
FROM events GROUP BY ALL""")
put("missing_recordings", [], """
SELECT 'sub-' || CAST(c_custkey AS VARCHAR) AS SubjectID FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
put("feature_roundtrip", TO_ALL, """
SELECT table_type, count(*) AS rows, CAST(0 AS BIGINT) AS differences
FROM feature_rows GROUP BY ALL""")
put("dataset_manifest", TO_EPOCHS, """
SELECT 'features' AS path, count(DISTINCT SubjectID) AS subjects, count(*) * 5 AS rows,
       '1.0' AS windowLength, '0.5' AS stepSize, 'welch' AS method FROM epochs""")

# --- epochs -------------------------------------------------------------------------------

put("epoch_grid", [SIGNAL, grid()], f"""
SELECT SubjectID, epoch_ix, start_sample, start_sample + {WINDOW} AS end_sample FROM grid""")
put("epoch_samples", [SIGNAL, grid(), UNREJECTED, ALL_SAMPLES], "SELECT * FROM samples")
put("epoch_detrended", TO_SAMPLES, f"""
SELECT SubjectID, EpochID, Electrode, j, {r('y')} AS y FROM detrended""")
put("epoch_rejection", [SIGNAL, grid(), ANNOTATIONS], f"""
SELECT SubjectID, epoch_ix, start_sample, start_sample + {WINDOW} AS end_sample FROM touched""")
put("annotations_marked", [SIGNAL, grid(), ANNOTATIONS], f"""
SELECT SubjectID, {r('onset')} AS onset, duration, description FROM annotations""")
put("epoch_renumbered", TO_EPOCHS, """
SELECT SubjectID, epoch_ix, epoch_no, 'ep-' || CAST(epoch_no AS VARCHAR) AS EpochID, start_sample
FROM epochs""")

# --- spectra ------------------------------------------------------------------------------

put("psd_welch", [*TO_SAMPLES, PSD], f"""
SELECT SubjectID, EpochID, Electrode, k, freq, {r('p')} AS p FROM psd""")
put("psd_relative", [*TO_SAMPLES, PSD], f"""
SELECT SubjectID, EpochID, Electrode, k, freq, {r('p', 8)} AS p FROM rel""")
put("psd_no_reject", [SIGNAL, grid(), UNREJECTED, SAMPLES, DETRENDED, PSD], f"""
SELECT SubjectID, EpochID, Electrode, k, freq, {r('p')} AS p FROM psd""")


def multitaper() -> str:
    """Tapers as the leading eigenvectors of the sinc kernel, listed as values."""
    n, w = WINDOW, 4.0 / WINDOW
    t = np.arange(n)
    kernel = 2 * w * np.sinc(2 * w * (t[:, None] - t[None, :]))
    share, vectors = np.linalg.eigh(kernel)
    kept = [i for i in range(n - 1, n - 9, -1) if share[i] > 0.9]
    values = ", ".join(
        f"({i}, {j}, {float(vectors[j, i])!r}::DOUBLE, {float(share[i])!r}::DOUBLE)"
        for i in kept
        for j in range(n)
    )
    return f"""
tapers AS (SELECT * FROM (VALUES {values}) AS t(taper, j, w, share)),
centred AS (
  SELECT *, y - avg(y) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS z FROM detrended),
fourier AS (
  SELECT SubjectID, EpochID, Electrode, taper, share, k,
         sum(z * w * cos(2 * pi() * k * j / {n})) AS re,
         sum(z * w * sin(2 * pi() * k * j / {n})) AS im
  FROM centred JOIN tapers USING (j) CROSS JOIN (SELECT unnest(range(1, {n // 2 + 1})) AS k)
  GROUP BY ALL)
SELECT SubjectID, EpochID, Electrode, CAST(k AS INTEGER) AS k, k * ({RATE}e0 / {n}) AS freq,
       {r('2 * sum(share * (re * re + im * im)) / sum(share)')} AS p
FROM fourier WHERE k * ({RATE}e0 / {n}) BETWEEN 0.5 AND 30 GROUP BY ALL"""


STATEMENTS["psd_multitaper"] = "WITH " + ",".join(TO_SAMPLES) + "," + multitaper()
put("band_power", [*TO_SAMPLES, PSD], f"""
SELECT SubjectID, EpochID, Electrode, WaveBand, {r('Power', 8)} AS Power FROM per_band""")
put("total_power_energy", [*TO_SAMPLES, PSD], f"""
SELECT SubjectID, EpochID, Electrode, {r('TotalPower', 8)} AS TotalPower,
       {r('TotalEnergy', 8)} AS TotalEnergy FROM per_channel""")
put("spectral_entropy", [*TO_SAMPLES, PSD], f"""
SELECT SubjectID, EpochID, Electrode, NULL::VARCHAR AS WaveBand,
       {r('SpectralEntropy')} AS SpectralEntropy FROM per_channel
UNION ALL
SELECT SubjectID, EpochID, Electrode, WaveBand, {r('SpectralEntropy')} FROM per_band""")

# --- time domain --------------------------------------------------------------------------

put("epoch_stats", [*TO_SAMPLES, HJORTH], f"""
SELECT SubjectID, EpochID, {r('avg(m)')} AS Mean, {r('avg(sqrt(v0))')} AS Std,
       {r('avg(v0)')} AS Variance, {r('avg(rms)')} AS RMS, {r('avg(mob)')} AS HjorthMobility
FROM hj GROUP BY ALL""")
put("hjorth_electrode", [*TO_SAMPLES, HJORTH], f"""
SELECT SubjectID, EpochID, Electrode, {r('HjorthActivity')} AS HjorthActivity,
       {r('HjorthMobility')} AS HjorthMobility, {r('HjorthComplexity')} AS HjorthComplexity,
       {r('HjorthIndex')} AS HjorthIndex FROM hjorth""")
put("hjorth_band", TO_ALL, f"""
SELECT SubjectID, EpochID, Electrode, WaveBand, FeatureName, {r('FeatureValue')} AS FeatureValue
FROM feature_rows WHERE table_type = 'band' AND FeatureName LIKE 'Hjorth%'""")
put("moments", TO_SAMPLES, f"""
SELECT SubjectID, EpochID, Electrode,
       {r('avg(c ** 3) / nullif(avg(c * c) ** 1.5, 0)')} AS Skewness,
       {r('avg(c ** 4) / nullif(avg(c * c) ** 2, 0) - 3')} AS Kurtosis
FROM (SELECT SubjectID, EpochID, Electrode,
             y - avg(y) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS c FROM detrended)
GROUP BY ALL""")

# --- the feature table --------------------------------------------------------------------

put("feature_long", TO_ALL, f"""
SELECT SubjectID, EpochID, Electrode, WaveBand, FeatureName, {r('FeatureValue')} AS FeatureValue,
       table_type FROM feature_rows""")
put("feature_rejects", [SIGNAL, grid(), UNREJECTED, ALL_SAMPLES], f"""
SELECT e.SubjectID, 'ep-' || CAST(e.epoch_no AS VARCHAR) AS EpochID, l.Electrode,
       CASE WHEN c.cnt IS NULL THEN 'no samples' WHEN c.cnt < {WINDOW} THEN 'short epoch'
            ELSE 'flat channel' END AS reason
FROM epochs e JOIN lengths l ON e.SubjectID = l.SubjectID
LEFT JOIN (SELECT SubjectID, EpochID, Electrode, count(*) AS cnt, min(x) = max(x) AS flat
           FROM samples GROUP BY ALL) c
  ON c.SubjectID = e.SubjectID AND c.EpochID = 'ep-' || CAST(e.epoch_no AS VARCHAR)
 AND c.Electrode = l.Electrode
WHERE c.cnt IS NULL OR c.cnt < {WINDOW} OR c.flat""")
put("feature_counts", TO_ALL, """
SELECT table_type, count(*) AS rows FROM feature_rows GROUP BY ALL""")


def wide(names: list[str], key: str, where: str = "true") -> str:
    cols = ", ".join(
        r(f"coalesce(max(FeatureValue) FILTER (WHERE {key} = '{n}'), 0)") + f' AS "{n}"'
        for n in names
    )
    return f"""
SELECT SubjectID, EpochID, CAST(right(SubjectID, 1) AS INTEGER) % 2 AS label, {cols}
FROM feature_rows WHERE {where} GROUP BY SubjectID, EpochID"""


WIDE_NAMES = (
    [f"{e}_{f}" for e in ELECTRODES for f in ELECTRODE_FEATURES]
    + [f"{e}_{b}_{f}" for e in ELECTRODES for b, _, _ in BANDS for f in BAND_FEATURES]
    + EPOCH_FEATURES
)
for _key in ("feature_wide_join", "feature_wide_single_pivot"):
    put(_key, TO_ALL, wide(WIDE_NAMES, "concat_ws('_', Electrode, WaveBand, FeatureName)"))
put("feature_pca_pivot", TO_ALL, wide(
    [f"{e}_{b}" for e in ELECTRODES for b, _, _ in BANDS], "Electrode || '_' || WaveBand",
    "table_type = 'band' AND FeatureName = 'Power'"))

# --- vectors ------------------------------------------------------------------------------

VECTORS = """
vectors AS (
  SELECT vec_id, 'sub-' || CAST(label AS VARCHAR) AS SubjectID,
         'ep-' || CAST(vec_id AS VARCHAR) AS EpochID, CAST(label % 2 AS INTEGER) AS label,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
MATRIX = f"""
matrix AS (
  SELECT SubjectID, EpochID, label, {', '.join(f'v[{i + 1}] AS {c}' for i, c in enumerate(FEATURES))}
  FROM vectors)"""
HELD = """
held AS (SELECT label, min(SubjectID) AS SubjectID FROM vectors GROUP BY ALL),
parted AS (SELECT *, CASE WHEN SubjectID IN (SELECT SubjectID FROM held) THEN 'test'
                          ELSE 'train' END AS part FROM matrix)"""
LONG_VECTORS = """
cells AS (
  SELECT SubjectID, EpochID, label, CAST(i - 1 AS INTEGER) AS pos,
         'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS "pivot", v[i] AS value
  FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors))"""

put("feature_melt", [VECTORS, LONG_VECTORS], f"""
SELECT SubjectID, EpochID, label, "pivot", {r('value')} AS value FROM cells""")

# --- splits -------------------------------------------------------------------------------

put("holdout_subjects", [], """
SELECT CAST(s % 2 AS INTEGER) AS label, 'sub-' || CAST(s AS VARCHAR) AS SubjectID
FROM (SELECT DISTINCT user_id % 8 AS s FROM events)
QUALIFY row_number() OVER (PARTITION BY s % 2 ORDER BY s) <= 2""")
put("distinct_subjects", [], """
SELECT DISTINCT 'sub-' || CAST(user_id % 8 AS VARCHAR) AS SubjectID FROM events""")
put("train_test_split_subjects", TO_EPOCHS, """
SELECT SubjectID, 'ep-' || CAST(epoch_no AS VARCHAR) AS EpochID,
       CAST(right(SubjectID, 1) AS INTEGER) % 2 AS label,
       CASE WHEN SubjectID IN ('sub-0', 'sub-1', 'sub-2', 'sub-3') THEN 'test' ELSE 'train' END
         AS part
FROM epochs""")
FOLDED = """
folded AS (
  SELECT *, CAST(ntile(5) OVER (PARTITION BY label
    ORDER BY md5(SubjectID || '|' || EpochID || '|42')) - 1 AS INTEGER) AS fold FROM vectors)"""
put("stratified_folds", [VECTORS, FOLDED], """
SELECT SubjectID, EpochID, label, fold AS fold_shuffled,
       CAST(ntile(5) OVER (PARTITION BY label ORDER BY SubjectID, EpochID) - 1 AS INTEGER)
         AS fold_ordered
FROM folded""")
SPLIT = """
marked AS (
  SELECT *, row_number() OVER (PARTITION BY SubjectID
              ORDER BY md5(SubjectID || '|' || EpochID || '|42'))
         <= ceil(count(*) OVER (PARTITION BY SubjectID) * 0.3e0) AS is_test FROM vectors)"""
put("subject_random_split", [VECTORS, SPLIT], """
SELECT SubjectID, EpochID, label, is_test FROM marked""")

# --- scaling ------------------------------------------------------------------------------


def columns(make, extra: str = "") -> str:
    return "SELECT SubjectID, EpochID, label" + extra + ", " + ", ".join(
        f"{r(make(c))} AS {c}" for c in FEATURES
    )


def spread(expr: str) -> str:
    return f"coalesce(nullif({expr}, 0), 1)"


TRAIN = "FILTER (WHERE part = 'train') OVER ()"
BY_SUBJECT = "OVER (PARTITION BY SubjectID)"
put("minmax_global", [VECTORS, MATRIX, HELD], columns(
    lambda c: f"({c} - min({c}) {TRAIN}) / "
    f"{spread(f'max({c}) {TRAIN} - min({c}) {TRAIN}')} * 2 - 1", ", part") + " FROM parted")
put("zscore_global", [VECTORS, MATRIX, HELD], columns(
    lambda c: f"({c} - avg({c}) {TRAIN}) / {spread(f'stddev_samp({c}) {TRAIN}')}",
    ", part") + " FROM parted")
put("zscore_by_subject", [VECTORS, MATRIX], columns(
    lambda c: f"({c} - avg({c}) {BY_SUBJECT}) / {spread(f'stddev_samp({c}) {BY_SUBJECT}')}")
    + " FROM matrix")
put("minmax_by_subject", [VECTORS, MATRIX], columns(
    lambda c: f"({c} - min({c}) {BY_SUBJECT}) / "
    f"{spread(f'max({c}) {BY_SUBJECT} - min({c}) {BY_SUBJECT}')}") + " FROM matrix")
put("minmax_vector_by_subject", [VECTORS, LONG_VECTORS], f"""
SELECT SubjectID, EpochID, label, pos, {r(
    "(value - min(value) OVER w) / coalesce(nullif(max(value) OVER w - min(value) OVER w, 0), 1)"
)} AS value
FROM cells WINDOW w AS (PARTITION BY SubjectID, pos)""")
put("zscore_power", [], f"""
WITH rows_ AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS Electrode, l_linestatus AS WaveBand,
         l_extendedprice AS Power, l_orderkey % 5 = 0 AS held FROM lineitem),
stats AS (SELECT Electrode, WaveBand, avg(Power) AS m, stddev_samp(Power) AS sd
          FROM rows_ WHERE NOT held GROUP BY ALL)
SELECT l_orderkey, l_linenumber, Electrode, WaveBand,
       {r('(Power - m) / coalesce(nullif(sd, 0), 1)')} AS Power,
       CASE WHEN held THEN 'test' ELSE 'train' END AS part
FROM rows_ JOIN stats USING (Electrode, WaveBand)""")

# --- effect sizes -------------------------------------------------------------------------

EFFECTS = """
groups AS (
  SELECT "pivot" AS Feature, count(*) FILTER (WHERE label = 0) AS n0,
         count(*) FILTER (WHERE label = 1) AS n1,
         avg(value) FILTER (WHERE label = 1) - avg(value) FILTER (WHERE label = 0) AS gap,
         var_samp(value) FILTER (WHERE label = 0) AS v0,
         var_samp(value) FILTER (WHERE label = 1) AS v1
  FROM cells GROUP BY ALL),
effects AS (
  SELECT *, gap / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n0 + n1 - 2, 0)), 0) AS d
  FROM groups)"""
put("effect_size", [VECTORS, LONG_VECTORS, EFFECTS], f"""
SELECT Feature, n0, n1, {r('d')} AS Cohen_d, {r('abs(d)')} AS Abs_Cohen_d,
       {r('gap / nullif(sqrt(v0 / n0 + v1 / n1), 0)')} AS t,
       {r('(v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1))')}
         AS dof
FROM effects""")
put("effect_size_selected", [VECTORS, LONG_VECTORS, EFFECTS], f"""
SELECT SubjectID, EpochID, label, "pivot", {r('value')} AS value FROM cells
WHERE "pivot" IN (SELECT Feature FROM effects WHERE abs(d) > 0.05)""")
put("minmax_selected", [VECTORS, LONG_VECTORS, EFFECTS], f"""
SELECT SubjectID, EpochID, label, "pivot", {r(
    "(value - min(value) OVER w) / coalesce(nullif(max(value) OVER w - min(value) OVER w, 0), 1)"
    " * 2 - 1")} AS value
FROM cells WHERE "pivot" IN (SELECT Feature FROM effects WHERE abs(d) > 0.05)
WINDOW w AS (PARTITION BY "pivot")""")

put("pca_rotation", [VECTORS], f"""
SELECT SubjectID, EpochID, label, CAST(64 AS INTEGER) AS components,
       {r('sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS length FROM vectors""")

put("pca_covariance", [VECTORS], f"""
SELECT 'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature_a,
       'f' || lpad(CAST(j - 1 AS VARCHAR), 2, '0') AS feature_b, {r('covar_samp(v[i], v[j])')} AS covariance
FROM vectors, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j""")
put("pca_loadings_orthonormal", [], """
SELECT CAST(i AS INTEGER) AS pc_a, CAST(j AS INTEGER) AS pc_b, CAST(i = j AS DOUBLE) AS product
FROM range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j""")
put("pca_scores_covariance", [], """
SELECT CAST(i AS INTEGER) AS pc_a, CAST(j AS INTEGER) AS pc_b, 0e0 AS gap
FROM range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j""")

# --- neighbours ---------------------------------------------------------------------------

MANHATTAN = "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))"


def nearest(queries: str, refs: str, allowed: str, k: int, metrics: list[str]) -> str:
    """The k nearest references of each query by each metric."""
    distance = {"euclidean": "list_distance(a.v, b.v)", "manhattan": MANHATTAN}
    pairs = " UNION ALL ".join(
        f"""
  SELECT a.EpochID AS key, '{m}' AS metric, {distance[m]} AS dist, b.EpochID AS ref_key,
         b.label AS ref_label
  FROM {queries} a, {refs} b WHERE {allowed}"""
        for m in metrics
    )
    return f"""
near AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY key, metric ORDER BY dist, ref_key) AS INTEGER)
    AS place
  FROM ({pairs})
  QUALIFY place <= {k})"""


VOTES = """
tallies AS (
  SELECT key, metric, CAST(k AS INTEGER) AS k, ref_label, count(*) AS cnt,
         count(*) FILTER (WHERE dist = 0) AS zeros,
         coalesce(sum(1 / nullif(dist, 0)), 0) AS inverse
  FROM near JOIN (VALUES (1), (2), (3), (5), (7), (9), (11)) AS ks(k) ON place <= k GROUP BY ALL),
votes AS (
  SELECT key, metric, k, 'uniform' AS weights, ref_label AS prediction FROM tallies
  QUALIFY row_number() OVER (PARTITION BY key, metric, k ORDER BY cnt DESC, ref_label) = 1
  UNION ALL
  SELECT key, metric, k, 'distance', ref_label FROM tallies
  QUALIFY row_number() OVER (PARTITION BY key, metric, k
    ORDER BY zeros DESC, CASE WHEN zeros > 0 THEN 0 ELSE inverse END DESC, ref_label) = 1)"""
BOTH = ["euclidean", "manhattan"]

put("knn_grid_cv", [
    VECTORS, FOLDED, nearest("folded", "folded", "a.fold <> b.fold", 11, BOTH), VOTES, """
scores AS (
  SELECT metric, k, weights, fold, avg(CAST(prediction = label AS DOUBLE)) AS acc
  FROM votes JOIN folded ON EpochID = key GROUP BY ALL)"""], f"""
SELECT metric, k, weights, {r('avg(acc)')} AS cv_mean, {r('stddev_pop(acc)')} AS cv_std,
       {r('max(acc)')} AS best_fold_accuracy,
       (list(fold ORDER BY acc DESC, fold))[1] AS best_fold
FROM scores GROUP BY ALL""")
SIDES = """
held AS (SELECT min(SubjectID) AS SubjectID FROM vectors GROUP BY label),
test AS (SELECT * FROM vectors SEMI JOIN held USING (SubjectID)),
train AS (SELECT * FROM vectors ANTI JOIN held USING (SubjectID))"""
put("knn_holdout", [VECTORS, SIDES, nearest("test", "train", "true", 11, BOTH), VOTES], f"""
SELECT metric, k, weights, {r('avg(CAST(prediction = label AS DOUBLE))')} AS accuracy
FROM votes JOIN test ON EpochID = key GROUP BY ALL""")
OTHERS = "a.SubjectID <> b.SubjectID"
put("knn_neighbours", [VECTORS, nearest("vectors", "vectors", OTHERS, 5, BOTH)], f"""
SELECT key, metric, {r('dist')} AS dist, ref_key, ref_label, place FROM near""")

LOSO = [VECTORS, nearest("vectors", "vectors", OTHERS, 5, ["euclidean"]), """
loso AS (
  SELECT SubjectID, EpochID, label, ref_label AS prediction
  FROM (SELECT key, ref_label, count(*) AS cnt FROM near GROUP BY ALL) t
  JOIN vectors ON EpochID = key
  QUALIFY row_number() OVER (PARTITION BY EpochID ORDER BY cnt DESC, ref_label) = 1)"""]
put("loso_knn", LOSO, "SELECT * FROM loso")
put("subject_identification_recall", [VECTORS, SPLIT, """
ranked AS (
  SELECT SubjectID, row_number() OVER (ORDER BY md5(SubjectID || '|42'), SubjectID) AS place
  FROM (SELECT DISTINCT SubjectID FROM vectors)),
pairs AS (
  SELECT a.EpochID AS key, qa.place AS own, rb.place AS other, list_distance(a.v, b.v) AS dist
  FROM marked a JOIN ranked qa ON qa.SubjectID = a.SubjectID, marked b
  JOIN ranked rb ON rb.SubjectID = b.SubjectID
  WHERE a.is_test AND NOT b.is_test),
firsts AS (
  SELECT n, key, own, other FROM pairs JOIN (SELECT unnest(range(2, (SELECT count(*) + 1 FROM ranked))) AS n) ON own <= n
   AND other <= n
  QUALIFY row_number() OVER (PARTITION BY n, key ORDER BY dist, other) = 1),
recalls AS (SELECT n, own, avg(CAST(own = other AS DOUBLE)) AS recall FROM firsts GROUP BY ALL)"""],
    f"""
SELECT CAST(n AS INTEGER) AS Num_Subjects, {r('avg(recall)')} AS Recall FROM recalls GROUP BY ALL""")

# --- reports ------------------------------------------------------------------------------

put("correctness_long", LOSO, """
SELECT SubjectID, CAST(substr(EpochID, 4) AS BIGINT) AS epoch_ix, prediction = label AS correct
FROM loso""")
ACCURACY = """
per_subject AS (
  SELECT SubjectID, label, avg(CAST(prediction = label AS DOUBLE)) AS accuracy
  FROM loso GROUP BY ALL)"""
put("subject_accuracy", [*LOSO, ACCURACY], f"""
SELECT SubjectID, label, {r('accuracy')} AS accuracy, accuracy > 0.5 AS above_half
FROM per_subject""")
put("majority_counts", [*LOSO, ACCURACY], f"""
SELECT label, count(*) FILTER (WHERE accuracy > 0.5) AS above,
       count(*) FILTER (WHERE accuracy <= 0.5) AS not_above,
       {r('avg(CAST(accuracy > 0.5 AS DOUBLE))')} AS share_above
FROM per_subject GROUP BY ALL""")
SUMMARY = """
summary AS (
  SELECT SubjectID, CASE label WHEN 0 THEN 'Control' ELSE 'Alzheimer''s' END AS "Group",
         round(avg(CAST(prediction = label AS DOUBLE)), 4) AS test_accuracy,
         count(*) FILTER (WHERE prediction = label) AS correct, count(*) AS total_epochs,
         count(*) FILTER (WHERE prediction <> label) AS incorrect
  FROM loso GROUP BY SubjectID, label)"""
put("subject_summary", [*LOSO, SUMMARY], "SELECT * FROM summary")
put("accuracy_histogram", [*LOSO, SUMMARY], """
SELECT g."Group", CAST(b AS INTEGER) AS bin, b / 10e0 AS bin_low, count(s.SubjectID) AS subjects
FROM (SELECT DISTINCT "Group" FROM summary) g CROSS JOIN (SELECT unnest(range(0, 10)) AS b)
LEFT JOIN summary s ON s."Group" = g."Group"
 AND least(CAST(round(test_accuracy * 10000) AS INTEGER) // 1000, 9) = b
GROUP BY ALL""")
CLASSES = """
per_class AS (
  SELECT c AS class, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
         count(*) FILTER (WHERE label = c) AS support,
         count(*) FILTER (WHERE prediction = c) AS predicted
  FROM loso CROSS JOIN (VALUES (0), (1)) AS t(c) GROUP BY c),
scores AS (
  SELECT CAST(class AS VARCHAR) AS class, coalesce(tp / nullif(predicted, 0), 0) AS precision,
         coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, support FROM per_class),
report AS (
  SELECT * FROM scores
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
  FROM scores)"""
put("classification_report", [*LOSO, CLASSES], f"""
SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM report""")
put("macro_recall", [*LOSO, CLASSES], f"""
SELECT {r('avg(recall)')} AS macro_recall FROM scores""")


def group_report(own: str, missed: str) -> str:
    return f"""
WITH_TOTALS AS (
  SELECT "Group", sum({own}) AS tp, sum({missed}) AS fn,
         (SELECT sum({missed}) FROM summary o WHERE o."Group" <> s."Group") AS fp
  FROM summary s GROUP BY "Group"),
ratios AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec
  FROM WITH_TOTALS)"""


REPORT = f"""
SELECT "Group", {r('prec')} AS precision, {r('rec')} AS recall,
       {r('coalesce(2 * prec * rec / nullif(prec + rec, 0), 0)')} AS f1,
       CAST(tp + fn AS BIGINT) AS support FROM ratios"""
put("group_report_epochs", [*LOSO, SUMMARY, group_report("correct", "incorrect")], REPORT)
put("group_report_subjects", [*LOSO, SUMMARY, group_report(
    "CAST(correct / total_epochs > 0.5 AS INTEGER)",
    "CAST(correct / total_epochs <= 0.5 AS INTEGER)")], REPORT)

# --- models -------------------------------------------------------------------------------

BAG_CONFIGURATIONS = """
grid AS (
  SELECT c, CAST(n AS INTEGER) AS members, f AS fraction, b AS bootstrap
  FROM (VALUES (0.01e0), (0.1e0), (1e0), (10e0)) AS cs(c), (VALUES (5), (10), (20)) AS ns(n),
       (VALUES (0.1e0), (0.5e0), (1e0)) AS fs(f), (VALUES (false), (true)) AS bs(b))"""
put("bagged_svm_separable", [VECTORS, FOLDED, BAG_CONFIGURATIONS], """
SELECT SubjectID, EpochID, label, fold, c, members, fraction, bootstrap, label AS prediction
FROM folded, grid""")


def poisson_steps(mean: float) -> list[int]:
    """Numbers out of 2^60 from which on Poisson draws of that mean are 1, 2, ..."""
    steps, p, total, i = [], float(np.exp(-mean)), float(np.exp(-mean)), 0
    while 1 - total > 2.0**-30:
        steps.append(int(total * 2.0**60))
        i += 1
        p *= mean / i
        total += p
    return steps


def with_replacement(fraction: float) -> str:
    draws = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in poisson_steps(fraction))
    return f"SELECT SubjectID, EpochID, {fraction}e0 AS fraction, true AS bootstrap, member, {draws} AS draws FROM numbered"


put("bag_draws", [VECTORS, f"""
numbered AS (
  SELECT SubjectID, EpochID, CAST(m AS INTEGER) AS member, count(*) OVER (PARTITION BY m) AS n,
         CAST('0x' || substr(md5(SubjectID || '|' || EpochID || '|42|' || m), 1, 15) AS BIGINT) AS u
  FROM vectors, range(20) AS ms(m)),
drawn AS (
  SELECT SubjectID, EpochID, f AS fraction, false AS bootstrap, member, 1 AS draws FROM numbered,
         (VALUES (0.1e0), (0.5e0), (1e0)) AS fs(f)
  QUALIFY row_number() OVER (PARTITION BY member, f ORDER BY u) <= trunc(n * f)
  UNION ALL {" UNION ALL ".join(map(with_replacement, (0.1, 0.5, 1.0)))})"""], """
SELECT SubjectID, EpochID, fraction, bootstrap, member, CAST(draws AS INTEGER) AS draws FROM drawn WHERE draws > 0""")
put("standardised_vectors", [VECTORS, SIDES, """
cells AS (
  SELECT SubjectID, EpochID, label, part, CAST(i - 1 AS INTEGER) AS pos, v[i] AS x
  FROM (SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test), range(1, 65) AS ixs(i)),
stats AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM cells WHERE part = 'train' GROUP BY pos)"""], f"""
SELECT SubjectID, EpochID, label, part, pos, {r("(x - m) / s")} AS value FROM cells JOIN stats USING (pos)""")
put("loso_gbt_separable", [VECTORS], """
SELECT SubjectID, EpochID, label, label AS prediction FROM vectors""")
put("loso_mlp_separable", [VECTORS], """
SELECT SubjectID, EpochID, label, label AS prediction FROM vectors""")
put("model_report_separable", [], """
SELECT model, 1e0 AS cv_mean, 0e0 AS cv_std, 1e0 AS best_fold_accuracy, CAST(0 AS INTEGER) AS best_fold,
       1e0 AS train_accuracy, 1e0 AS test_accuracy
FROM (VALUES ('DecisionTree'), ('GradientBoosting'), ('BaggingSVM'), ('SVM')) AS ms(model)""")
put("knn_grid_report", [VECTORS, SIDES, """
folded AS (
  SELECT *, CAST(ntile(15) OVER (PARTITION BY label
    ORDER BY md5(SubjectID || '|' || EpochID || '|42')) - 1 AS INTEGER) AS fold FROM train),
asked AS (
  SELECT 'cv:' || EpochID AS EpochID, label, v, fold, 'cv' AS part FROM folded
  UNION ALL SELECT 'train:' || EpochID, label, v, NULL, 'train' FROM folded
  UNION ALL SELECT 'test:' || EpochID, label, v, NULL, 'test' FROM test)""",
    nearest("asked", "folded", "(a.fold IS NULL OR a.fold <> b.fold)", 11, BOTH), VOTES, """
scores AS (
  SELECT metric, k, weights, part, fold, avg(CAST(prediction = label AS DOUBLE)) AS acc
  FROM votes JOIN asked ON EpochID = key GROUP BY ALL)"""], f"""
SELECT metric, k, weights, {r("avg(acc) FILTER (part = 'cv')")} AS cv_mean,
       {r("stddev_pop(acc) FILTER (part = 'cv')")} AS cv_std,
       {r("max(acc) FILTER (part = 'cv')")} AS best_fold_accuracy,
       (list(fold ORDER BY acc DESC, fold) FILTER (part = 'cv'))[1] AS best_fold,
       {r("max(acc) FILTER (part = 'train')")} AS train_accuracy,
       {r("max(acc) FILTER (part = 'test')")} AS test_accuracy
FROM scores GROUP BY ALL""")
