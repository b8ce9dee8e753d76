from kveil.plans.anonymize import anonymize, run_anonymize
from kveil.plans.examine import examine, run_examine
from kveil.plans.explore import run_explore

__all__ = ["anonymize", "run_anonymize", "examine", "run_examine", "run_explore"]
