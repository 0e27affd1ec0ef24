from casespark.plans.registry import REGISTRY, query  # noqa: F401
