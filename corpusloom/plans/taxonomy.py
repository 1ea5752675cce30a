"""The category system: codes, parents and families, and the names that lead to a code."""

from __future__ import annotations

# Parent labels and their children, in canonical order.
FAMILIES: dict[str, list[str]] = {
    "economic_frame": ["eco_neg_impact", "eco_pos_impact", "eco_cost", "eco_benefit", "eco_footprint"],
    "health_frame": ["health_neg_impact", "health_cobenefit"],
    "security_frame": ["security_refugees", "security_conflict", "security_military", "security_disruption"],
    "justice_frame": ["justice_winners", "justice_responsibility", "justice_vulnerability", "justice_access", "justice_intergen"],
    "political_frame": ["pol_action", "pol_debate", "pol_position", "pol_opinion"],
    "scientific_frame": ["sci_debate", "sci_discovery", "sci_skepticism", "sci_defense"],
    "environmental_frame": ["env_habitat", "env_species"],
    "cultural_frame": ["cult_art", "cult_event_impact", "cult_indigenous", "cult_footprint"],
    "messenger": ["msg_health", "msg_economic", "msg_security", "msg_legal", "msg_cultural", "msg_scientist", "msg_social", "msg_activist", "msg_official"],
    "event": ["evt_weather", "evt_meeting", "evt_publication", "evt_election", "evt_policy", "evt_judiciary", "evt_cultural", "evt_protest"],
    "solution": ["sol_mitigation", "sol_adaptation"],
}
STANDALONE = ["tone_positive", "tone_negative", "tone_neutral", "canada", "urgency"]

PRIMARY = list(FAMILIES)
FRAMES = PRIMARY[:8]
CODES = [c for parent, children in FAMILIES.items() for c in (parent, *children)] + STANDALONE
NUMBER = {c: k + 1 for k, c in enumerate(CODES)}
PARENT = {c: parent for parent, children in FAMILIES.items() for c in children}
