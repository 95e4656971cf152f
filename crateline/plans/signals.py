"""Queries of prints, audio features and series, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import catalog, duplicates, series
from ..session import table, written
from ..skew import union_all
from .queries import HOURS, IDENTICAL, SAME, T, hourly, tracks
from .registry import query

#: Words of a print made for a track: those of its title, every other one with a bit changed by the track.
WORDS = 120


def made_prints(s, d):
    """Prints for the tracks, which have none: copies of one title differ in a bit or two of each word.

    (id, v, words), packed, v the duration. A word is the first three bytes of a digest of the title and its number, a bit
    the first two of one of the id and the number.
    """
    t = catalog.latest(tracks(s, d), "title", "duration_ms").filter(F.trim("title") != "")
    own = t.select("id", F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("v"), F.lower(F.trim("title")).alias("title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [b"/%d" % i for i in range(WORDS)]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, v, titles = b.slice(at, 1000).columns
                digests = b"".join([md5(w + e).digest()[:3] for w in (x.encode() for x in titles.to_pylist()) for e in ends])
                of_ids = b"".join([md5(k + e).digest()[:2] for k in (b"%d" % x for x in ids.to_pylist()) for e in ends[1::2]])
                words = np.frombuffer(digests, np.uint8).reshape(-1, WORDS, 3).astype(np.uint32) @ np.array([1 << 16, 1 << 8, 1], np.uint32)
                words[:, 1::2] ^= np.uint32(1) << np.frombuffer(of_ids, ">u2").reshape(-1, WORDS // 2).astype(np.uint32) % 24
                raw = np.ascontiguousarray(words.astype("<u4").view(np.uint8).reshape(-1, WORDS, 4)[:, :, :3]).tobytes()
                yield pa.RecordBatch.from_arrays([ids, v, pa.array([b"\x03" + raw[k : k + 3 * WORDS] for k in range(0, len(raw), 3 * WORDS)], pa.binary())], names=["id", "v", "words"])

    # a few bytes of each track make hundreds, so small tasks
    return own.repartition(2 * s.sparkContext.defaultParallelism, F.xxhash64("id")).mapInArrow(run, "id bigint, v bigint, words binary")


@query(f"""WITH RECURSIVE {T}, v AS (SELECT id, lower(trim(title)) AS w, coalesce(duration_ms, 0) AS d FROM t WHERE trim(title) <> ''), l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.w = b.w AND a.id <> b.id AND abs(a.d - b.d) <= 15000),
    r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(root) AS component FROM r GROUP BY id),
    k AS (SELECT component, id, nullif(trim(fingerprint), '') AS fp, CASE WHEN trim(artist) <> '' AND trim(title) <> '' THEN lower(trim(artist)) || chr(31) || lower(trim(title)) END AS song FROM m JOIN t USING (id)),
    g AS (SELECT component, count(*) AS n FROM k GROUP BY component HAVING count(*) >= 2 AND NOT (count(fp) = count(*) AND count(DISTINCT fp) = 1) AND NOT (count(song) = count(*) AND count(DISTINCT song) = 1))
    SELECT id, component, n FROM m JOIN g USING (component)""")
def acoustic_classes(s, d):
    """Tracks that sound alike: prints that match at some shift, durations within 15 s, connected."""
    t = catalog.latest(tracks(s, d), "duration_ms", "fingerprint", "artist", "title")
    return duplicates.acoustic_classes(t, made_prints(s, d))




@query(f"WITH {HOURS} SELECT event_type, hour, round(avg(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM h")
def moving_average(s, d):
    return series.smoothed(hourly(s, d), "event_type", "hour", "v")


@query(f"WITH {HOURS} SELECT event_type, hour, round(greatest(v + 1.2::DOUBLE * (v - avg(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)), 0), 6) AS sharp FROM h")
def local_contrast(s, d):
    return series.sharpened(hourly(s, d), "event_type", "hour", "v")


@query("""WITH p AS (SELECT label, vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT label, vec_id, round(CASE WHEN b IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(v, b), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) END, 6) AS novelty FROM p""")
def novelty_series(s, d):
    """How much each profile differs from the one before of its label."""
    return series.novelties(table(s, d, "embeddings"), "label", "vec_id", "embedding")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: round(list_reduce(v[1:i], lambda a, x: a + (x - a) * CASE WHEN x >= a THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END), 6)) AS follow FROM e""")
def followed_vectors(s, d):
    """Vectors through a follower that is fast up and slow down."""
    return series.followed(table(s, d, "embeddings"), "vec_id", "embedding", 0.8, 0.1)


@query("""SELECT vec_id, list_transform(range(0, 10), lambda i: CASE WHEN i * 7 >= len(embedding) THEN 0 ELSE CAST(round(least(list_max(list_transform(embedding[i * 7 + 1:i * 7 + 7], lambda x: abs(x::DOUBLE))), 1) * 255) AS INTEGER) END) AS preview FROM embeddings""")
def preview_bins(s, d):
    """A preview of ten bars of each vector."""
    return table(s, d, "embeddings").select("vec_id", series.binned(F.col("embedding"), 10).alias("preview"))


@query(f"""WITH {HOURS}, x AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS r FROM h), z AS (SELECT event_type, sum(x * x) AS zero FROM x GROUP BY 1),
    f AS (SELECT a.event_type, b.r - a.r AS lag, round(sum(a.x * b.x) / max(zero), 6) AS acf FROM x a JOIN x b ON a.event_type = b.event_type AND b.r - a.r BETWEEN 1 AND 192 JOIN z ON z.event_type = a.event_type GROUP BY 1, 2),
    c AS (SELECT l.event_type, l.lag, round(sum(f.acf / k.k) * exp(-0.5 * power(log2(l.lag / 24.0::DOUBLE) / 0.65::DOUBLE, 2)), 9) AS score FROM (SELECT event_type, lag FROM f WHERE lag <= 48) l, (SELECT unnest([1, 2, 3, 4]) AS k) k, f WHERE f.event_type = l.event_type AND f.lag = l.lag * k.k GROUP BY 1, 2),
    n AS (SELECT *, lag(score) OVER w AS b, lead(score) OVER w AS a FROM c WINDOW w AS (PARTITION BY event_type ORDER BY lag)), m AS (SELECT event_type, median(score) FILTER (score > 0) AS mid FROM c GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, lag) AS place FROM n)
    SELECT t.event_type, CAST(lag AS INTEGER) AS lag, round(lag + CASE WHEN abs(b - 2 * score + a) > 1e-9 THEN least(greatest(0.5 * (b - a) / (b - 2 * score + a), -1), 1) ELSE 0 END, 6) AS refined, round(1 - mid / score, 6) AS confidence FROM t JOIN m USING (event_type) WHERE place = 1 AND score > 0""")
def period_of_series(s, d):
    """The best period in hours of each kind of event: comb over the autocorrelation, prior, parabola, confidence."""
    return series.periods(series.autocorrelation(hourly(s, d), "event_type", "hour", "v", 192), "event_type", 48, 24.0, 0.65)


P = "60000.0::DOUBLE / greatest({b}, 1)"


def _shift_sql(b: str, f: str, ph: str, by: str) -> str:
    p = P.format(b=b)
    n = f"CASE WHEN {f} + {by} < 0 THEN ceil(-({f} + {by}) / ({p})) ELSE 0 END"
    return f"round({f} + {by} + ({n}) * ({p}), 3) AS first, CAST((({ph} - ({n})) % 4 + 4) % 4 AS INTEGER) AS phase"


GRIDS = "g AS (SELECT track_id, bpm, beat_offset_ms::DOUBLE AS f, ((1 - coalesce(first_beat_number, 1)) % 4 + 4) % 4 AS ph FROM analysis WHERE track_id IS NOT NULL AND bpm > 0 AND beat_offset_ms IS NOT NULL)"


def grids(s, d):
    a = table(s, d, "analysis").filter("track_id is not null and bpm > 0 and beat_offset_ms is not null")
    return a.select("track_id", "bpm", F.col("beat_offset_ms").cast("double").alias("first"), F.pmod(1 - F.coalesce("first_beat_number", F.lit(1)), F.lit(4)).alias("phase"))


@query(f"""WITH {GRIDS}, s AS (SELECT track_id, 'shift' AS edit, bpm, {_shift_sql("bpm", "f", "ph", "-300")} FROM g), n AS (SELECT track_id, 'snap' AS edit, bpm, {_shift_sql("bpm", "f", "ph", f"(1000 - (f + round((1000 - f) / ({P.format(b='bpm')})) * ({P.format(b='bpm')})))")} FROM g) SELECT * FROM s UNION ALL SELECT * FROM n""")
def grid_moves(s, d):
    """Grids shifted by 300 ms towards the start, and snapped to the first second."""
    g = grids(s, d)
    b, f, p = F.col("bpm"), F.col("first"), F.col("phase")
    edit = lambda name, x: g.select("track_id", F.lit(name).alias("edit"), x.alias("x")).select("track_id", "edit", "x.bpm", F.round("x.first", 3).alias("first"), "x.phase")
    return edit("shift", series.grid_shifted(b, f, p, F.lit(-300.0))).unionByName(edit("snap", series.grid_snapped(b, f, p, F.lit(1000.0))))


@query(f"""WITH {GRIDS}, l AS (SELECT track_id, bpm, f, ph, {P.format(b="bpm")} AS p FROM g), x AS (SELECT *, p / 30000.0::DOUBLE * 400 AS px, unnest(generate_series(CAST(floor(-f / p) AS BIGINT), CAST(ceil((30000 - f) / p) AS BIGINT))) AS i FROM l WHERE p / 30000.0::DOUBLE * 400 >= 2)
    SELECT track_id, round((f + i * p) / 30000 * 400, 3) AS x, ((i - ph) % 4 + 4) % 4 = 0 AS is_downbeat FROM x WHERE f + i * p BETWEEN 0 AND 30000 AND (px >= 6 OR ((i - ph) % 4 + 4) % 4 = 0)""")
def visible_beats(s, d):
    """The beat lines of the first half minute on 400 pixels."""
    return series.beat_lines(grids(s, d), 0.0, 30.0, 400.0)


@query()
def analysed_tempi(s, d):
    """Everything the analyser finds in click tracks made for every distinct tempo tag."""
    from ..functions.dsp import analyse

    tempos = tracks(s, d).filter("bpm_tag between 70 and 180").select(F.round("bpm_tag").cast("bigint").alias("track_id")).distinct()
    rate, seconds = 8000, 12
    step = F.lit(60.0 * rate) / F.col("track_id")
    samples = F.transform(F.sequence(F.lit(0), F.lit(rate * seconds - 1)), lambda i: F.when(F.pmod(i.cast("double"), step) < 60, 0.8 * F.cos(i * 0.7)).otherwise(0.0).cast("float"))
    made = tempos.select("track_id", F.lit(rate).alias("sample_rate"), samples.alias("samples"))
    return analyse(made.repartition(16, "track_id")).select("track_id", "bpm", "beat_offset_ms", "first_beat_number", "key_tonic", "peak", F.size("audio_fingerprint").alias("words"), F.length("waveform_bands").alias("bands"), "content_hash", "error")


@query(f"""WITH RECURSIVE {T}, v AS (SELECT id, lower(trim(title)) AS w, coalesce(duration_ms, 0) AS d FROM t WHERE trim(title) <> ''), l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.w = b.w AND a.id <> b.id AND abs(a.d - b.d) <= 15000),
    r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(root) AS component FROM r GROUP BY id),
    k AS (SELECT component, id, nullif(trim(fingerprint), '') AS fp, CASE WHEN trim(artist) <> '' AND trim(title) <> '' THEN lower(trim(artist)) || chr(31) || lower(trim(title)) END AS song FROM m JOIN t USING (id)),
    g AS (SELECT component, count(*) AS n FROM k GROUP BY component HAVING count(*) >= 2 AND NOT (count(fp) = count(*) AND count(DISTINCT fp) = 1) AND NOT (count(song) = count(*) AND count(DISTINCT song) = 1))
    SELECT 'acoustic' AS kind, 'acoustic' || chr(31) || component AS group_key, n, component AS first_id FROM g UNION ALL {IDENTICAL} UNION ALL {SAME}""")
def duplicate_groups(s, d):
    """Groups of all three kinds; an acoustic group is named by its smallest id, its members are in acoustic_classes."""
    t = catalog.latest(tracks(s, d), "duration_ms", "fingerprint", "artist", "title")
    classes = duplicates.acoustic_classes(t, made_prints(s, d)).select(F.lit("acoustic").alias("kind"), F.concat(F.lit("acoustic\x1f"), F.col("component").cast("string")).alias("group_key"), "n", F.col("component").alias("first_id")).distinct()
    # each kind shuffles all tracks, so one after the other
    return union_all([written(g, free=True) for g in (classes, duplicates.identical_groups(t), duplicates.same_track_groups(t))])
