import os

import pytest

from tests.conftest import spark  # noqa: F401 - the session fixture

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test data not present")
    return SMALL
