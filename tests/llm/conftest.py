from tests.conftest import data, row, sample, samples, spark  # noqa: F401
