"""The five verbs as pure plans, and their effects."""
