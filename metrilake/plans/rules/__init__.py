"""Rule packs: the monitoring deployment's rule groups as :class:`RuleGroup` objects."""
