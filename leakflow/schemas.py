"""Table shapes of the package, as DDL."""

FRAGMENT = "fragment_id long, raw string, start_line long, attributes map<string,string>"
RULE = "rule_id string, description string, regex string, path string, secret_group int, keywords array<string>, confidence string, specificity int, skip_report boolean, filter string, components array<struct<rule_id:string,optional:boolean,within:string>>"
FINDING = "fragment_id long, rule_id string, start_line long, end_line long, start_column long, end_column long, start long, end long, match string, secret string, line string, entropy double, specificity int, confidence string"
COMMIT = "oid string, tree string, parents array<string>, date long"
TREE_ENTRY = "tree_oid string, name string, oid string, kind string"
AUDIT = "id long, ts string, os_user string, identity string, cwd string, argv string, env_subset string, backend string, backend_path string, mode string, shortcut string, exit_code int, duration_ms long, enrichment string, prev_hash string, row_hash string"
