"""Schemas of the engine's tables, as Spark DDL."""

TURNS = "conv_id string, turn_idx int, role string, text string, ts timestamp"
ENTITIES = (
    "id string, type string, name string, aliases array<string>, current_state map<string,string>, created_from string, "
    "first_seen double, last_seen double, importance double, web_canonical_name string, web_description string, web_verified boolean, "
    "valid_from double, valid_to double"
)
TRANSITIONS = (
    "id string, entity_id string, from_state map<string,string>, to_state map<string,string>, transition_type string, "
    "trigger_conversation_id string, trigger_summary string, timestamp double, confidence double, valid_at double, ingested_at double"
)
EDGES = (
    "id string, source_id string, target_id string, type string, description string, source_conversation_id string, "
    "timestamp double, valid_from double, valid_to double"
)
FACTS = "subject string, role string, object string, start int, end int"
STAGE_VISITS = "prospect_id string, seq int, stage string, entered timestamp, exited timestamp, days double"
EXTRACTION = (
    "entities array<struct<name:string,type:string,state:string,is_new:boolean,matches_existing:string,confidence:double,date:string>>, "
    "state_changes array<struct<entity_name:string,what_changed:string,from_state:string,old_state:string,to_state:string,new_state:string,"
    "is_contradiction:boolean,confidence:double>>, "
    "relationships array<struct<source:string,target:string,type:string,description:string>>, "
    "period_context string, significance double, user_state string, summary string"
)

# The vocabularies of the data model.
ENTITY_TYPES = ("person", "project", "tool", "organization", "belief", "decision", "concept", "period", "event")
#: Told types that stand for a belief; other unknown ones are concepts.
BELIEF_TYPES = ("preference",)
TRANSITION_TYPES = ("creation", "update", "contradiction", "resolution", "archival")
RELATIONSHIP_TYPES = (
    "uses", "works_on", "collaborates_with", "related_to", "part_of", "caused_by", "during", "replaces", "integrates_with",
)
STAGES = ("lead", "discovery", "qualification", "demo", "evaluation", "proposal", "negotiation", "closed_won", "closed_lost")
