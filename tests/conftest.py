import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gridcast.session import build_session
    s = build_session("local[*]", 8, app_name="gridcast-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="gridcast-test-ckpt-")})
    yield s
    s.stop()


def to_rows(df, cols=None):
    pdf = df.toPandas()
    cols = cols or list(pdf.columns)
    return pdf[cols]
