"""DataFrame operators: declarative transforms over whole tables."""
