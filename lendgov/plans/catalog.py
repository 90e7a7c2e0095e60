"""Imports every query module so that registration runs."""

from . import (  # noqa: F401
    q_advice,
    q_audit,
    q_consent,
    q_explain,
    q_fairness,
    q_features,
    q_files,
    q_models,
    q_monitoring,
    q_pipeline,
    q_requests,
    q_streaming,
)
