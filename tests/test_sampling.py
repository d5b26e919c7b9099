"""Intervals closed by events, against a plain loop."""

import datetime
import random

import pytest

from threadhaul.operators.sampling import sampled_rates

ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def plain(rows, least_ms, amounts=False):
    """(series, microsecond, items, elapsed ms) of each close."""
    out, begun, count = set(), {}, {}
    for series, at, amount in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or "", r[1])):
        count[series] = count.get(series, 0) + ((amount or 0) if amounts else 1)
        last = begun.setdefault(series, at)
        same = [r for r in rows if r[0] == series and r[1] == at]
        # Rows of one instant count together, at the last of them.
        seen = begun.setdefault(("seen", series, at), 0) + 1
        begun["seen", series, at] = seen
        if at - last >= least_ms * 1000 and seen == len(same):
            out.add((series, at, count[series], (at - last) / 1000))
            begun[series], count[series] = at, 0
    return out


def got(frame, by=("s",)):
    rows = frame.collect()
    micro = datetime.timedelta(microseconds=1)
    keys = {(r[by[0]] if by else None, (r.closed_at.astimezone(datetime.timezone.utc) - ZERO) // micro, r["items"], r.elapsed_ms) for r in rows}
    assert len(keys) == len(rows)
    assert all(abs(r.per_second - r["items"] / r.elapsed_ms * 1000) < 1e-9 for r in rows)
    return keys


@pytest.mark.parametrize("chunk", (1, 2, 7, 1000))
def test_sampled_rates_equal_a_plain_loop(spark, chunk):
    rng, rows = random.Random(chunk), []
    for series, gap in (("dense", 3_000), ("even", 50_000), ("sparse", 400_000), (None, 90_000)):
        at = rng.randrange(10**6)
        for _ in range(400):
            rows.append((series, at, rng.choice((1, 2, None))))
            at += rng.choice((0, gap, rng.randrange(2 * gap), 100_000 if rng.random() < 0.1 else gap // 3))
    rows += [("alone", 5, 1), ("dense", None, 1), ("two", 0, 1), ("two", 100_000, 1), ("near", 0, 1), ("near", 99_999, 1)]
    frame = spark.createDataFrame(
        [(s, None if at is None else ZERO + datetime.timedelta(microseconds=at), a) for s, at, a in rows], "s string, ts timestamp, a int"
    ).repartition(4)
    assert got(sampled_rates(frame, "ts", ["s"], 100, chunk=chunk)) == plain(rows, 100)
    assert got(sampled_rates(frame, "ts", ["s"], 100, amount=frame.a, chunk=chunk)) == plain(rows, 100, amounts=True)
    whole = [(None, at, a) for _, at, a in rows]
    assert got(sampled_rates(frame, "ts", [], 100, chunk=chunk), ()) == plain(whole, 100)


def test_sampled_rates_of_nothing(spark):
    frame = spark.createDataFrame([], "s string, ts timestamp")
    assert sampled_rates(frame, "ts", ["s"]).collect() == []
