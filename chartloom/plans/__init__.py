"""Jobs made of operators."""

from chartloom.plans.cohort_build import CohortResult, build_cohort, write_cohort
from chartloom.plans.documents import (
    AnnotationParse,
    AssembleDocuments,
    NlpRequests,
    SchemaMap,
    TextScrub,
    annotate_documents,
)
from chartloom.plans.transform import Flow, FlowResult, Param, Transform, split_failed

__all__ = [
    "AnnotationParse", "AssembleDocuments", "CohortResult", "Flow", "FlowResult", "NlpRequests", "Param", "SchemaMap",
    "TextScrub", "Transform", "annotate_documents", "build_cohort", "split_failed", "write_cohort",
]
