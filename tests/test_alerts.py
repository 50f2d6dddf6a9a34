"""Alert rules: the keyed state against a plain version over all flows, for any cut into batches."""

import random

import pytest

from tidewire.streaming.alerts import _SUMS, METRICS, OPERATORS, STATE_STORE, Rule, Watch, start_alerts


class Value:
    def __init__(self):
        self.of = {}

    def exists(self):
        return bool(self.of)

    def get(self):
        return self.of[()]

    def update(self, value):
        self.of[()] = value


class Mapped:
    def __init__(self):
        self.of = {}

    def containsKey(self, key):
        return key in self.of

    def getValue(self, key):
        return self.of[key]

    def updateValue(self, key, value):
        self.of[key] = value

    def removeKey(self, key):
        del self.of[key]

    def iterator(self):
        return iter(list(self.of.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Mapped()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class Partial(dict):
    __getattr__ = dict.get


def plain(rule, flows, end):
    """flows: (ts, bytes); all windows from the first flow's to the last that has ended."""
    out, fired = [], None
    start = min(flows)[0] // rule.window_ms * rule.window_ms
    while start + rule.window_ms <= end:
        here = [b for t, b in flows if start <= t < start + rule.window_ms]
        value = len(here) if rule.metric == "flow_count" else sum(here)
        if OPERATORS[rule.operator](value, rule.threshold) and (fired is None or start + rule.window_ms - fired >= rule.cooldown_ms):
            fired = start + rule.window_ms
            out.append((start, float(value)))
        start += rule.window_ms
    return out


@pytest.mark.parametrize("seed", range(60))
def test_state(seed):
    rng = random.Random(seed)
    rule = Rule("r", rng.choice(["flow_count", "byte_count"]), rng.choice(list(OPERATORS)), rng.choice([0, 1, 2, 30]), 10, rng.choice([0, 5, 10, 25, 100]))
    flows = sorted((rng.choice([rng.randrange(300), 1000 + rng.randrange(50)]) + 7, rng.randrange(20)) for _ in range(40))
    watch, got, now = Watch([rule]), [], 0
    watch.init(Handle())
    at = 0
    while at < len(flows):
        n = rng.randrange(1, 12)
        batch, at = flows[at : at + n], at + n
        rng.shuffle(batch)
        rows = [Partial(zip(("window_start", *_SUMS), (t // 10 * 10, 1, b, 0, 0, 0))) for t, b in batch]
        list(watch.handleInputRows(("r",), iter(rows), Clock(now)))
        now = max(t for t, _ in flows[:at]) - 3
        while due := sorted(t for t in watch.handle.timers if t <= now):
            watch.handle.timers.discard(due[0])
            got += [(r.window_start, r.value) for r in watch.handleExpiredTimer(("r",), Clock(now), None)]
    assert got == plain(rule, flows, now)
    late = [Partial(zip(("window_start", *_SUMS), (0, 9, 9, 0, 0, 0)))]
    before = dict(watch.windows.of)
    if now >= 20:
        list(watch.handleInputRows(("r",), iter(late), Clock(now)))
        assert watch.windows.of == before


def test_rules_are_checked(spark):
    for wrong in ({"metric": "speed"}, {"operator": "!="}, {"window_ms": 0}, {"cooldown_ms": -1}):
        with pytest.raises(ValueError):
            Rule(**{"id": "a", "metric": METRICS[0], "operator": ">", "threshold": 1, "window_ms": 1} | wrong)


def test_the_session_keeps_its_state_store(spark, tmp_path):
    before = spark.conf.get(STATE_STORE)
    flows = spark.createDataFrame([], "ts_ms long, byte_count long, packet_count long, is_anomaly boolean, protocol string")
    (tmp_path / "in").mkdir()
    running = start_alerts(spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in")), [Rule("a", "flow_count", ">", 1, 1000)], str(tmp_path / "out"), str(tmp_path / "state"), seconds=0)
    running.stop()
    assert spark.conf.get(STATE_STORE) == before
    with pytest.raises(ValueError, match="different ids"):
        start_alerts(flows, [Rule("a", "flow_count", ">", 1, 1000)] * 2, "x", "y")
