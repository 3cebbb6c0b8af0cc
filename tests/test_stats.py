"""p-values and closed forms against published quantiles."""

from __future__ import annotations

import math

import numpy as np
import pytest

from kpisleuth.functions import stats
from kpisleuth.operators import confidence, evidence


@pytest.mark.parametrize("t,df,p", [
    (2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05), (3.169273, 10, 0.01), (0.0, 5, 1.0), (-2.228139, 10, 0.05),
])
def test_student_p(t, df, p):
    assert stats.student_t_p(t, df) == pytest.approx(p, abs=2e-6)


def test_student_p_without_freedom():
    assert math.isnan(stats.student_t_p(1.0, 0))


@pytest.mark.parametrize("a,b,x", [(2.0, 3.0, 0.4), (0.5, 0.5, 0.3), (10.0, 1.5, 0.9)])
def test_incomplete_beta_by_quadrature(a, b, x):
    grid = (np.arange(2_000_000) + 0.5) / 2_000_000
    density = grid ** (a - 1) * (1 - grid) ** (b - 1)
    assert stats.incomplete_beta(a, b, x) == pytest.approx(density[grid <= x].sum() / density.sum(), abs=2e-3)


def test_chi_square_golden(spark):
    counts = spark.createDataFrame([(21, 13, 2, 32)], "a long, b long, c long, d long")
    row = evidence.chi_square_2x2(counts).withColumn("p", stats.p_chi2_1("chi2")).first()
    assert row["chi2"] == pytest.approx(21.2870, abs=1e-4)
    assert row["chi2_uncorrected"] == pytest.approx(23.7179, abs=1e-4)
    assert row["p"] < 0.001


def test_weighted_confidence_golden(spark):
    case = spark.createDataFrame([(0.93, 1.00, 0.84, 0.90, 0.72, 0.79)], "s1 double, s2 double, s3 double, s4 double, s5 double, s6 double")
    assert confidence.raw_confidence(case).first()["raw"] == pytest.approx(0.8876, abs=1e-9)


def test_functions_travel_without_the_package(tmp_path):
    """Executors need not have the package: pickled functions carry their code."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps(stats.student_t_p))
    code = f"import pickle; print(pickle.load(open({str(blob)!r}, 'rb'))(2.228139, 10))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert float(out.stdout.strip().splitlines()[-1]) == pytest.approx(0.05, abs=1e-6)
