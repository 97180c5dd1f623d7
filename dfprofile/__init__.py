"""dfprofile: Spark-native automated exploratory data analysis."""

from .config import DEFAULT, ProfileConfig
from .plans.report import Profile, profile

__all__ = ["DEFAULT", "Profile", "ProfileConfig", "profile"]
