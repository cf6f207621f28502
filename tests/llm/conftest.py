import pytest


@pytest.fixture(autouse=True, scope="session")
def one_wave():
    """Waves only bound what is on disk at a time; small tables take one each, apart from the test of waves."""
    from diffspark.llm import word_model

    word_model.TRAIN_WAVES = word_model.SCORE_WAVES = 1
