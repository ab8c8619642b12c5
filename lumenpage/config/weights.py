"""Metrics, pillars, calibration and bands."""

# Metric id -> (key, pillar, weight in the pillar, status, effort).
METRICS = {
    1: ("direct_answer", "structural", 0.30, "measured", 1), 2: ("headings", "structural", 0.20, "measured", 1), 3: ("chunkability", "structural", 0.25, "measured", 2),
    4: ("structured_data", "structural", 0.25, "measured", 2), 5: ("information_density", "information", 0.20, "measured", 2), 6: ("fact_density", "information", 0.30, "measured", 2),
    7: ("attribution", "information", 0.25, "proxy", 2), 8: ("coverage", "information", 0.25, "proxy", 3), 9: ("entity_presence", "entity", 0.20, "measured", 1),
    10: ("entity_clarity", "entity", 0.30, "measured", 1), 11: ("relationships", "entity", 0.20, "measured", 2), 12: ("relevance", "entity", 0.30, "measured", 2),
    13: ("mentions", "authority", 0.30, "measured", 3), 14: ("diversity", "authority", 0.25, "measured", 3), 15: ("citation_share", "authority", 0.25, "measured", 3),
    16: ("citation_value", "authority", 0.20, "estimate", 1),
}
PILLARS = {"structural": 0.25, "information": 0.25, "entity": 0.25, "authority": 0.25}
BANDS = [(85, "Strong"), (70, "Good"), (50, "Developing"), (30, "Weak"), (0, "Very weak")]
INTENT_VALUE = {"commercial": 1.0, "transactional": 1.0, "local": 0.85, "informational": 0.6, "howto": 0.55, "navigational": 0.45}
PRIORITY = {"weakness": 0.35, "impact": 0.20, "query": 0.15, "entity": 0.10, "effort": 0.10, "evidence": 0.10}
EVIDENCE_STRENGTH = {"measured": 1.0, "proxy": 0.7, "estimate": 0.4}
THRESHOLD = 75.0
SIM_RANGE = (0.02, 0.35)
RELEVANT, COVER_HIGH, COVER_LOW = 0.12, 0.28, 0.10
FACT_TARGET = 3.0
# What each metric has to have.
NEEDS = {
    1: "text of the page, and a query", 2: "text of the page", 3: "text of the page", 4: "HTML of the page", 5: "text of the page, and a query", 6: "text of the page", 7: "text of the page", 8: "text of the page, and a query",
    9: "text of the page, and an entity", 10: "text of the page, and an entity", 11: "text of the page, and an entity", 12: "text of the page, an entity, and a query", 13: "external pages, linked or pasted", 14: "external pages, linked or pasted",
    15: "answers with their citations", 16: "a query and an entity; answers and external pages help",
}
