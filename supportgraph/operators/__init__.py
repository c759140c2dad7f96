"""Table operators: checks, edges, search, context windows, conversations, triage."""
