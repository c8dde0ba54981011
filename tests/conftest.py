import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wordreel.session import local_session  # noqa: E402

WORDS = ("take_id bigint, idx bigint, start_ms bigint, end_ms bigint, text string, "
         "hinglish string, devanagari string")


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4g", "wordreel-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def words(spark):
    """Words of takes given as {take: [(start, end, text), ...]}."""
    def make(takes):
        rows = [(t, i, s, e, x, None, None) for t, ws in takes.items()
                for i, (s, e, x) in enumerate(ws)]
        return spark.createDataFrame(rows, WORDS)

    return make


@pytest.fixture
def media(spark):
    def make(lengths):
        rows = [(t, ms, 29.97, 1080, 1920, True, 2, 48000, True, f"/m/take {t}.mp4")
                for t, ms in lengths.items()]
        return spark.createDataFrame(
            rows, "take_id bigint, duration_ms bigint, fps double, width int, height int, "
                  "has_audio boolean, channels int, sample_rate int, measured boolean, "
                  "file_name string")

    return make
