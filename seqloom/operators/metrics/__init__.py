from seqloom.operators.metrics import contrastive, diversity, ranking, values
from seqloom.operators.metrics.registry import evaluate, metric, per_user_metric, registered

__all__ = ["contrastive", "diversity", "evaluate", "metric", "per_user_metric", "ranking", "registered", "values"]
