import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nameshift import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


SNIPPETS = [
    (1, "int total = 0; for (int i = 0; i < size; i++) total += values[i]; return total;", 1),
    (2, "int count = 0; while (count < limit) { count = count + step; } return count;", 1),
    (3, "char *name = getenv(key); if (name == 0) return fallback; return name;", 0),
    (4, "char *path = getenv(key); strcpy(buffer, path); return buffer;", 0),
    (5, "int total = base; total = total + step; return total;", 0),
    (6, "return;", 1),
    (7, "", 0),
    (8, "int sum = 0; /* total */ for (int j = 0; j < size; j++) sum += values[j]; return sum; // total", 1),
    (9, "char *text = getenv(name); strcpy(target, text); return target;", 0),
]


@pytest.fixture(scope="session")
def snippets(spark):
    return spark.createDataFrame(SNIPPETS, "sample_id long, code string, label long")


@pytest.fixture(scope="session")
def inputs(snippets):
    from nameshift.plans.inputs import AttackInputs

    return AttackInputs.prepare(snippets, snippets, smoothing=3.0, block_size=20)
