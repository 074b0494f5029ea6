import datetime as dt

from lagscope import schemas

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def naive(minutes: float) -> dt.datetime:
    return at(minutes).replace(tzinfo=None)


def snapshot_rows(spark, rows):
    """(group, topic, partition, committed, end, commit minute or None, minute)"""
    data = [
        (g, t, p, c, e, None if m is None else at(m), at(s)) for g, t, p, c, e, m, s in rows
    ]
    return spark.createDataFrame(data, schemas.OFFSET_SNAPSHOT)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
