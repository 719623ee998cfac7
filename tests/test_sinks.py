import json

import pytest

from tracemark.sources import sinks


def test_writers_refuse_what_they_would_cut(spark):
    assert len(json.loads(sinks.document(spark.range(10_000)))) == 10_000 and len(sinks.markdown(spark.range(1000)).split("\n")) == 1002
    for write, n in ((sinks.document, 10_001), (sinks.markdown, 1001)):
        with pytest.raises(ValueError):
            write(spark.range(n))
