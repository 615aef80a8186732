"""All registered queries; importing the modules fills the registry."""

from corrobora.plans import (q_admission, q_audit, q_graph, q_intake, q_matching,  # noqa: F401
                             q_provenance, q_sinks, q_streaming)
from corrobora.plans.registry import ORACLES, QUERIES  # noqa: F401
