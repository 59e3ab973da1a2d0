"""The layers as plans: raw to silver, silver to gold, gold views and dashboard queries."""
