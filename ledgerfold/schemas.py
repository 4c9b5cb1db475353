"""Explicit schemas. Nothing is inferred."""

ADDRESS = "struct<street:string,number:string,zip:string,city:string,state:string,country:string>"
DEPARTMENT_REF = "struct<id:string>"

USER_JOURNAL = (
    f"entity_id string, seq_nr bigint, ts timestamp_ntz, kind string, username string, email string, pass string, "
    f"address {ADDRESS}, department {DEPARTMENT_REF}, tag string, timebucket string"
)
DEPARTMENT_JOURNAL = (
    "entity_id string, seq_nr bigint, ts timestamp_ntz, kind string, name string, description string, "
    "tag string, timebucket string"
)
USER_COMMANDS = (
    f"cmd_id bigint, cmd_ts timestamp_ntz, entity_id string, kind string, username string, email string, pass string, "
    f"address {ADDRESS}, department {DEPARTMENT_REF}, subject string, expires_at timestamp_ntz"
)
DEPARTMENT_COMMANDS = (
    "cmd_id bigint, cmd_ts timestamp_ntz, entity_id string, kind string, name string, description string, "
    "subject string, expires_at timestamp_ntz"
)
USER_VIEW = f"id string, username string, email string, address {ADDRESS}, department {DEPARTMENT_REF}"
