"""DataFrame -> DataFrame operators over gridded fields, profiles and prediction pairs."""
