import hashlib
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opinarium.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def seeded_encoder(dim=16):
    """Equal texts give equal unit vectors, whatever the prefix before a query."""

    def factory():
        def encode(texts):
            rows = []
            for text in texts:
                bare = text.rpartition("Query:")[2]
                seed = int.from_bytes(hashlib.sha256(bare.encode()).digest()[:8], "big")
                rows.append(np.random.default_rng(seed).standard_normal(dim))
            return np.array(rows, dtype=np.float32).reshape(len(rows), dim)

        return encode

    return factory


REVIEW_SCHEMA = (
    "product_id string, product_name string, product_brand string, site_category_lv1 string, "
    "site_category_lv2 string, overall_rating int, review_text string"
)


def review(product, name, brand, rating):
    return (product, name, brand, "Eletronicos", "Diversos", rating, "texto")


@pytest.fixture(scope="session")
def corpus_reviews(spark):
    rows = [review("C1", "Smartphone Galaxy", "samsung", r) for r in (5, 4, 5)]
    rows += [review("C2", "Geladeira Frost", "brastemp", r) for r in (1, 2)]
    rows += [review("C3", "Notebook Dell", "dell", r) for r in (5, 1, 4, 2)]
    return spark.createDataFrame(rows, REVIEW_SCHEMA)


@pytest.fixture(scope="session")
def storefront_reviews(spark):
    rows = [review("S1", "Smartphone Galaxy", "samsung", 5)]
    rows += [review("S2", "Cafeteira Inissia", "nespresso", r) for r in (4, 3)]
    return spark.createDataFrame(rows, REVIEW_SCHEMA)
