"""See the module names for what each part holds."""
