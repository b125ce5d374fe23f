import threading
import time

import pytest

from bough.jobs import Runtime
from bough.model import EngineError


def test_results_errors_and_counts(spark):
    r = Runtime(spark, workers=2, max_queue=2, max_per_owner=2)
    assert r.submit(lambda: spark.range(5).count()).await_(60) == 5
    bad = r.submit(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.await_(60)
    assert bad.status() == "failed"
    go = threading.Event()
    a = r.submit(go.wait, owner="x")
    r.submit(go.wait, owner="x")
    with pytest.raises(EngineError) as e:
        r.submit(go.wait, owner="x")
    assert e.value.code == "busy" and e.value.retryable
    with pytest.raises(EngineError) as e:
        a.await_(0.05)
    assert e.value.code == "await_timeout"
    go.set()
    assert a.await_(60) is True
    time.sleep(0.2)
    s = r.stats()
    assert (s["submitted"], s["rejected"], s["failed"], s["in_flight"]) == (4, 1, 1, 0)
    r.close()


def test_timeout_and_cancel(spark):
    r = Runtime(spark, workers=1)

    def slow():
        time.sleep(3)
        return spark.range(5).count()

    with pytest.raises(EngineError) as e:
        r.submit(slow, timeout_ms=500).await_(60)
    assert e.value.code == "timeout"
    job = r.submit(slow)
    time.sleep(3)  # the one before holds the worker until it is done
    assert job.status() == "running"
    waiting = r.submit(slow)
    waiting.cancel()
    job.cancel()
    for j in (job, waiting):
        with pytest.raises(EngineError) as e:
            j.await_(60)
        assert e.value.code == "cancelled"
    r.close()
