import pytest

from millrace.llm import store


@pytest.fixture(scope="session", autouse=True)
def no_waiting():
    """Shuffle files of small tables may stay a while."""
    store.SETTLES = 0
