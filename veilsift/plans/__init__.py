"""Complete checks composed from the operators."""

from .check_changes import ChangeCheck, check_changes
from .check_packages import PackageCheck, check_packages, scoring_requests
from .review import review_requests, score_requests

__all__ = [
    "ChangeCheck", "PackageCheck", "check_changes", "check_packages", "review_requests",
    "score_requests", "scoring_requests",
]
