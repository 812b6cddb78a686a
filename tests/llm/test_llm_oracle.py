import pytest
from clinframe.llm import registry

import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, sf_dir, name):
    assert oracle.same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE[name]) > 0
