"""What keeps the operators within their limits on large tables, held on small ones."""

from deltadoc.llm import quality


def test_texts_are_not_joined_before_they_are_measured(spark, sf_dir, monkeypatch):
    """Only the bounded sample of labels, which is broadcast, meets texts."""
    kind = type(spark.range(0))
    joined, join = [], kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, *a, **b: joined.append((self.columns, "broadcast" in other._jdf.queryExecution().analyzed().toString().lower())) or join(self, other, *a, **b))
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    quality.fit(docs, labels)
    assert joined and all(hint or "text" not in columns for columns, hint in joined)
