import pytest

from inkloom.llm.lookalike import standard


@pytest.fixture(scope="session")
def classes():
    return standard(keep_breaks=False)
