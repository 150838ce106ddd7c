import pytest

from .samples import odd_documents


@pytest.fixture
def odd(spark):
    return odd_documents(spark)
